"""Hard negatives of a set of anchors: a secondary sort of packed pair scores, read by a streaming iterator.

Anchors meet all rows in blocks: a group holds at most about ``ANCHORS`` anchors and ``ROWS`` rows, whatever labels or copies
they have, and one matrix product scores it. A first round takes each block's best positives per anchor, of which the
best of all become the anchor's positives. A second round takes, for each window that a positive opens, a block's
best negatives inside it; no other row of the block can be among the window's best of all, so nothing else needs to move.

Each pair that is left becomes a key of fixed width (anchor, descending score, kind, id) whose bytes sort in that order.
``repartitionAndSortWithinPartitions`` brings the keys of an anchor together in one stream. A positive sorts ahead of all
negatives of its window: it opens the window; negatives fall into the open windows they fit until a window is full or left
behind. The iterator holds the open windows of one anchor, never its rows.

Defined results: rows without vec_id or label, with a null vector, or with a null or non-finite component take no part. Vectors of
different lengths do not meet. Repeated rows are rows of their own, as anchors too. Components and scores beyond
64 bits are cut to their bounds. An anchor without another row of its label, or a positive without a row in its window,
gives no rows, nor does an empty table. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import partitions, ship, spool

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
#: Rows and anchors in a block, and anchors scored at a time.
ROWS, ANCHORS, _TILE = 8_192, 16_384, 256
_EXACT = 2.0 ** 53
_MOST = np.iinfo(np.int64).max
_SIGN = 1 << 63
_KEY = struct.Struct(">QQBQ")


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the greatest whole score n with low * score <= 100 * n <= high * score; empty if the first is larger."""
    return -(-low * score // 100), high * score // 100


def pack(anchor: int, score: int, kind: int, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, kind and id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, kind, vec_id + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, vec_id = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, kind, vec_id - _SIGN


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices, cut to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a.astype(float)).max() * np.abs(b.astype(float)).max() * a.shape[1] < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -_MOST, _MOST).astype(np.int64)


def _best(score: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n of ``at`` with the highest scores; of equal ones the first."""
    if len(at) > n:
        least = np.partition(score[at], len(at) - n)[len(at) - n]
        at = at[score[at] >= least]
    return at[np.argsort(-score[at], kind="stable")][:n]


def _block(rows: pa.Table, dims: int):
    """Anchors and rows of a block, rows by id, as (columns, matrix); scores come a tile of anchors at a time."""
    rows = rows.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
    anchor = rows.column("anchor").to_numpy(zero_copy_only=False)
    vectors = rows.column("q").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dims)
    columns = {c: rows.column(c).to_numpy() for c in ("rid", "vec_id", "label")}
    sides = []
    for side in (anchor, ~anchor):
        sides.append(({c: v[side] for c, v in columns.items()}, flat[side]))
    return sides, [w for w, is_anchor in zip(rows.column("windows").to_pylist(), anchor) if is_anchor]


def _scored(anchors, others, x, y):
    for at in range(0, len(x), _TILE):
        for i, score in enumerate(products(x[at:at + _TILE], y), at):
            yield i, score, others["label"] == anchors["label"][i]


def _positives(count: int):
    """Each anchor's best rows of its own label in a block."""

    def positives(key: tuple, rows: pa.Table) -> pa.Table:
        ((anchors, x), (others, y)), _ = _block(rows, key[0].as_py())
        rid, score, vec_id = [], [], []
        for i, scores, same in _scored(anchors, others, x, y):
            found = _best(scores, np.flatnonzero(same & (others["rid"] != anchors["rid"][i])), count)
            rid.append(np.full(len(found), anchors["rid"][i]))
            score.append(scores[found])
            vec_id.append(others["vec_id"][found])
        none = [np.zeros(0, np.int64)]
        return pa.table({"rid": np.concatenate(rid + none), "score": np.concatenate(score + none), "vec_id": np.concatenate(vec_id + none)})

    return positives


def _negatives(count: int, low: int, high: int):
    """The packed keys of a block's best negatives of each window of each anchor."""

    def negatives(key: tuple, rows: pa.Table) -> pa.Table:
        ((anchors, x), (others, y)), windows = _block(rows, key[0].as_py())
        rid, keys = [], []
        for i, scores, same in _scored(anchors, others, x, y):
            found: set[int] = set()
            for positive in set(windows[i]):
                least, most = window(positive, low, high)
                if least <= most:
                    found.update(_best(scores, np.flatnonzero(~same & (scores >= least) & (scores <= most)), count).tolist())
            anchor = int(anchors["rid"][i])
            rid.extend([anchor] * len(found))
            keys.extend(pack(anchor, int(scores[j]), 1, int(others["vec_id"][j])) for j in found)
        return pa.table({"rid": pa.array(rid, pa.int64()), "pair": pa.array(keys, pa.binary())})

    return negatives


def read_sorted(keys: Iterable[tuple[bytes, int]], count: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive id, rank, negative id, positive score, negative score) from keys in order, each with its anchor's id."""
    at, anchor_id, windows = None, 0, []
    for key, vec_id in keys:
        anchor, score, kind, other = unpack(key)
        if anchor != at:
            at, anchor_id, windows = anchor, vec_id, []
        if kind == 0:
            least, most = window(score, low, high)
            windows.append([least, most, 0, other, score])
            continue
        windows = [w for w in windows if w[0] <= score and w[2] < count]
        for w in windows:
            if score <= w[1]:
                w[2] += 1
                yield anchor_id, w[3], w[2], other, w[4], score


def _participants(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.transform(x, lambda v: F.floor(v * 256)).alias("q"), is_anchor.alias("is_anchor"))


def _blocks(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int) -> DataFrame:
    """Every row with every block of anchors, and every anchor with every block of rows."""
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(n)).cast("int")

    columns = [F.size("q").alias("dims"), "rid", "vec_id", "label", "q"]
    sent = rows.select(*columns, F.lit(False).alias("anchor"), F.lit(None).cast("array<long>").alias("windows"),
                       own(row_blocks, 1).alias("row_block"), every(anchor_blocks).alias("anchor_block"))
    asked = anchors.select(*columns, F.lit(True).alias("anchor"), "windows", every(row_blocks).alias("row_block"),
                           own(anchor_blocks, 2).alias("anchor_block"))
    return sent.unionByName(asked).groupBy("dims", "row_block", "anchor_block")


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    ``is_anchor`` is a condition on the columns of ``vectors``, by default a vec_id divisible by 100.
    """
    spark = vectors.sparkSession
    ship(spark)
    wanted = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    rows = spool(_participants(vectors, wanted), "negatives-rows")
    n, asked = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    blocks = 1 + n // ROWS, 1 + asked // ANCHORS
    anchors = rows.where("is_anchor")
    near = (_blocks(rows, anchors.withColumn("windows", F.lit(None).cast("array<long>")), *blocks)
            .applyInArrow(_positives(positives), "rid long, score long, vec_id long"))
    best = F.row_number().over(W.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    chosen = spool(near.withColumn("place", best).where(F.col("place") <= positives).drop("place"), "negatives-positives")
    opened = spool(anchors.join(chosen.groupBy("rid").agg(F.collect_list("score").alias("windows")), "rid"), "negatives-anchors")
    found = _blocks(rows, opened, *blocks).applyInArrow(_negatives(negatives, low, high), "rid long, pair binary")
    ids = anchors.select("rid", F.col("vec_id").alias("anchor_id"))
    negative = found.join(ids, "rid").select("pair", "anchor_id").rdd.map(lambda r: (bytes(r[0]), r[1]))
    positive = (chosen.join(ids, "rid").select("rid", "score", "vec_id", "anchor_id").rdd
                .map(lambda r: (pack(r[0], r[1], 0, r[2]), r[3])))
    ordered = (negative.union(positive)
               .repartitionAndSortWithinPartitions(partitions(spark), lambda key: zlib.crc32(key[:8])))
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(ordered.mapPartitions(lambda keys: read_sorted(keys, negatives, low, high)), shape)
