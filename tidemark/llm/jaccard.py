"""Exact Jaccard join of word shingles as a join in a metric space.

Jaccard distance is a metric, so distances to a pivot bound the distance of two documents: they link
(distance at most r = 1/4) only if |d(x, p) - d(y, p)| <= r. Nearly all documents are at distance 1 from
nearly all others, so a cell of arbitrary pivots would hold everything. The cells here are those of
shingle pivots: with all shingles in one fixed order, common ones last, two documents that link share a
shingle among the first quarter of each (n - ceil(3n/4) + 1 of n), so the documents that have a shingle
there form a region, and every link lies inside a region. Each region is joined recursively:

* each gets a first pivot, and the distance of all to it, which settles that pivot. Regions of the same documents count as one;
* a region ends as soon as its documents are connected;
* of a region of few documents, those that are not connected yet are compared;
* of a larger one, some pivots of its largest connected part and some outside it are compared in each round with the documents
  of the other parts, except where the triangle inequality over the first pivot rules a link out. The documents within r of a
  pivot are its Voronoi cell and connected through it. The pivots are then settled; of the others only those go on that lie in
  the triangle-inequality window of a document of another part.

Before any two sets are compared, their sketches are: counts of shingles by range of hash. Counts that differ
by k mean k different shingles, a lower bound of the distance that rules out nearly all pairs that do not link, so only
sets that may link at all are stored. Before that, a pair is ruled out by two bounds that need no set: its shared shingles lie from that of the
region on in both, where a pair's first shared one is due, and sets differ in as many shingles at least as the parities of their counts
in 256 ranges.

No link between different texts is lost and no group is expanded into all pairs. Equal sets are one
class from the start, by a 64-bit hash of the set.

Defined results: null and empty texts have no shingles and link with nothing; with fewer words than a
shingle the whole sequence is one shingle. A row without doc_id links with nothing and has a null
component_id. Rows of one doc_id with different texts link by their own text. Repeated rows are kept.
Columns other than the id and the text are not read. An empty table gives no rows. Texts of any length are read whole, a few at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import (arrow_type, bloom_filter, bloom_has, bucketed, connected_components, hash_words, let_go, map_arrow, mix64,
                                 partitions, pieces_of, spool, text_bytes, word_bounds, words_per_row)

#: Shingles known to be common, put last in the order (1.5 MB). Any order is right; a good one is fast.
COMMON = 1 << 17
#: Documents of a region that are compared directly: in the first round, and at most after some.
LEAF, LAST_LEAF = 16, 128
#: Pivots of a larger region: outside its largest connected part (in the first round, then eight times as many in
#: each) and inside it.
OUTER_PIVOTS, INNER_PIVOTS = 32, 4
#: Hash buckets of the shingle index.
BUCKETS = 1024
#: A place in a set's order is kept in so many equal parts of the set; a region's lie in the first quarter of them.
PLACES = 1024
#: Shingles a task counts at a time, and common ones it reports of them.
COUNTED, REPORTED = 2_000_000, 1 << 14


def shingles(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its shingles."""
    data, rows = text_bytes(column)
    starts, ends = word_bounds(data, rows)
    word = hash_words(data, starts, ends)
    count = words_per_row(starts, rows)
    at = np.concatenate([[0], np.cumsum(count)])
    run = np.zeros(max(len(word) - words + 1, 0), np.uint64)
    for k in range(words):
        run = mix64(run * np.uint64(0x9E3779B97F4A7C15) + word[k:k + len(run)] + np.uint64(words))
    for i, n in enumerate(count):
        if n >= words:
            yield np.unique(run[at[i]:at[i] + n - words + 1])
        elif n:
            whole = np.full(1, n, np.uint64)  # the length is part of the hash, so it equals no longer shingle
            for k in range(at[i], at[i + 1]):
                whole = mix64(whole * np.uint64(0x9E3779B97F4A7C15) + word[k] + np.uint64(n))
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    at = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    total = np.bitwise_xor.reduce(mix64(hashes + at * np.uint64(0xD1B54A32D192ED03))) if len(hashes) else np.uint64(0)
    return int(mix64(np.array([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


#: Words of a set's parities, as columns.
_PARITIES = ("odd0", "odd1", "odd2", "odd3")
_MARKS = "doc_id long, n int, cls long, sketch binary, " + "".join(f"{w} long, " for w in _PARITIES) + "common boolean"


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of 256 ranges of hashes holds an odd number of shingles; two sets differ in a shingle at least where these do."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """How many shingles fall into each of 2**k equal ranges of hashes, about four to a range, 255 at most."""
    bits = min(max(int(len(hashes) // 4).bit_length(), 4), 12)
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_distance(x: bytes, y: bytes, nx: int, ny: int) -> float:
    """A lower bound of the Jaccard distance: ranges whose counts differ by k differ in k shingles at least."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(x), len(y))
    apart = int(np.abs(x.reshape(size, -1).sum(1) - y.reshape(size, -1).sum(1)).sum())
    return 2 * apart / (nx + ny + apart)


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [least_distance(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "p")), pa.array(near, pa.float64())], ["a", "b", "p", "near"])


def _mark(words: int):
    """Rows (doc_id, n, cls, sketch), and common shingles as rows (n: documents of the task, cls: hash) without doc_id."""
    out = arrow_type(_MARKS)

    def report(held: list[np.ndarray]):
        hashes, count = np.unique(np.concatenate(held), return_counts=True)
        some = np.flatnonzero(count >= 3)
        some = some[np.argsort(-count[some], kind="stable")[:REPORTED]]
        return pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(count[some].astype(np.int32)),
                                           pa.array(hashes[some].view(np.int64)), pa.nulls(len(some), pa.binary()),
                                           *[pa.nulls(len(some), pa.int64()) for _ in _PARITIES], pa.array(np.ones(len(some), bool))], schema=out)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for batch in batches:
            for piece in pieces_of(batch):
                n, cls, sketches, odd = [], [], [], [np.zeros((0, len(_PARITIES)), np.int64)]
                for s in shingles(piece.column("text"), words):
                    n.append(len(s))
                    cls.append(set_key(s))
                    sketches.append(sketch(s))
                    odd.append(parities(s)[None])
                    if len(s) and cls[-1] not in seen:
                        seen.add(cls[-1])
                        held.append(s)
                        total += len(s)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), pa.array(n, pa.int32()),
                                                  pa.array(cls, pa.int64()), pa.array(sketches, pa.binary()),
                                                  *map(pa.array, np.concatenate(odd).T.copy()), pa.array(np.zeros(len(n), bool))], schema=out)
                if total > COUNTED:
                    yield report(held)
                    held, total = [], 0
        if held:
            yield report(held)

    return mark


def _entries(words: int, common: np.ndarray, rank: np.ndarray):
    """The first shingles of each set in the shared order, packed by hash bucket."""
    out = arrow_type("bucket int, entries binary")
    kind = np.dtype([("h", "<u8"), ("cls", "<i8"), ("at", "u1")])

    def packed(h: list, cls: list, rare: list, at: list):
        h, cls, rare, at = np.concatenate(h), np.concatenate(cls), np.concatenate(rare), np.concatenate(at)
        # common shingles are known to be shared: they need no counting and are dealt out evenly by set
        bucket = np.where(rare, h, mix64(cls.view(np.uint64) + h)) >> np.uint64(64 - (BUCKETS.bit_length() - 1))
        bucket = bucket.astype(np.int64) * 2 + ~rare
        order = np.argsort(bucket, kind="stable")
        rows = np.zeros(len(h), kind)
        rows["h"], rows["cls"], rows["at"], bucket = h[order], cls[order], at[order], bucket[order]
        ids, first = np.unique(bucket, return_index=True)
        ends = np.append(first[1:], len(rows))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], schema=out)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, cls, rare, place, total, seen = [], [], [], [], 0, set()
        for batch in batches:
            for piece in pieces_of(batch):
                for s in shingles(piece.column("text"), words):
                    key = set_key(s)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    at = np.searchsorted(common, s)
                    at[at == len(common)] = 0
                    known = common[at] == s if len(common) else np.zeros(len(s), bool)
                    order = np.lexsort((s, np.where(known, rank[at], -1))) if known.any() else np.arange(len(s))
                    order = order[:len(s) - (3 * len(s) + 3) // 4 + 1]
                    h.append(s[order])
                    cls.append(np.full(len(order), key, np.int64))
                    rare.append(~known[order])
                    # rounded down, which makes a place earlier than it is and so rules out less
                    place.append(np.minimum(np.arange(len(order)) * PLACES // len(s), 255).astype(np.uint8))
                    total += len(order)
                if total > COUNTED // 4:
                    yield packed(h, cls, rare, place)
                    h, cls, rare, place, total = [], [], [], [], 0
        if h:
            yield packed(h, cls, rare, place)

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        let_go()
        rows = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column("entries")])
        rows = rows[np.lexsort((rows["cls"], rows["h"]))]
        again = (rows["h"][1:] == rows["h"][:-1]) & (rows["cls"][1:] == rows["cls"][:-1])
        rows = rows[np.append(True, ~again)] if len(rows) else rows
        if key[0].as_py() % 2 == 0 and len(rows):
            same = rows["h"][1:] == rows["h"][:-1]
            rows = rows[np.append(same, False) | np.append(False, same)]
        return pa.table({"h": np.ascontiguousarray(rows["h"]).view(np.int64), "cls": np.ascontiguousarray(rows["cls"]),
                         "at": rows["at"].astype(np.int32)})

    return emit, shared


def _sets(words: int, wanted) -> object:
    """Sets of the rows that pass the Bloom filter: (cls, hashes)."""
    out = arrow_type("cls long, hashes binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "kk")]
            batch = batch.filter(pa.array(bloom_has(wanted.value, *numbers)))
            for piece in pieces_of(batch):
                own = list(shingles(piece.column("text"), words))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], schema=out)

    return sets


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            d.append((both, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([m for m, _ in d], pa.int32()),
                                          pa.array([u for _, u in d], pa.int32())], ["a", "b", "common", "total"])


def jaccard_components(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text); similarity 0.75 or more links."""
    spark, r, eps = docs.sparkSession, 0.25, 1e-9
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    marks = spool(map_arrow(docs, _mark(words), _MARKS), "shingle-sets")
    sets = marks.where("not common").select("doc_id", "n", "cls")
    parts = partitions(spark)
    classes = (marks.where("not common and doc_id is not null and n > 0").groupBy("cls")
               .agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), *(F.min(w).alias(w) for w in _PARITIES)).repartition(parts, "cls"))
    classes = bucketed(classes, "cls", parts, "classes")

    common = marks.where("common").groupBy("cls").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cls").limit(COMMON).toPandas()
    hashes = common["cls"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    rank = np.arange(len(hashes), 0, -1)[order] if len(hashes) else np.zeros(1, np.int64)
    emit, shared = _entries(words, hashes[order], rank)
    entries = map_arrow(docs.where("doc_id is not null").select("text"), emit, "bucket int, entries binary")
    region = spool(entries.groupBy("bucket").applyInArrow(shared, "h long, cls long, at int").join(classes.select("cls", "n"), "cls")
                   .select("h", "cls", "n", "at"), "regions")
    # regions of the same documents are one, known by a hash of them; classes are hashes, so the least is a pivot that regions of one group mostly share
    members = region.groupBy("h").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("same"), F.min("cls").alias("centre"),
                                     F.sum("at").alias("place")).where("size > 1")
    # of such regions the first one in the order counts, which has the earliest place in each of its documents
    members = members.groupBy("size", "same", "centre").agg(F.min(F.struct("place", "h")).alias("first")).select("centre", "first.h")
    members = members.join(classes.select(F.col("cls").alias("centre"), F.col("n").alias("nc")), "centre").select("h", "centre", "nc")
    region = region.join(members, "h").where("cls <> centre")
    region = spool(region.withColumns({"lo": F.least("n", "nc"), "hi": F.greatest("n", "nc")}), "regions")
    unknown = spark.createDataFrame([], "a long, b long, near double, far double")

    def pair(x: str, nx: str, y: str, ny: str):
        """Columns of a pair, with y as its pivot."""
        return (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.col(y).alias("p"), F.least(nx, ny).alias("lo"), F.greatest(nx, ny).alias("hi"))

    def joined(pairs: DataFrame, store: DataFrame, *columns: str) -> DataFrame:
        """Pairs (a, b, p) with columns of both classes as x.. and y..; p is one of them, the pivot if there is one.

        The stored rows stay in their buckets; those of pivots, which may be in many pairs, are sent to the pairs first.
        """
        pivots = store.select(F.col("cls").alias("p"), *(F.col(c).alias(f"x_{c}") for c in columns)).join(pairs.select("p").distinct(), "p", "left_semi")
        others = store.select(F.col("cls").alias("q"), *(F.col(c).alias(f"y_{c}") for c in columns))
        pairs = pairs.withColumn("q", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))
        return pairs.join(pivots, "p").join(others, "q")

    def bounded(pairs: DataFrame) -> DataFrame:
        """(a, b, p, near) of the distinct pairs not known yet, with a lower bound of the distance."""
        fresh = pairs.groupBy("a", "b").agg(F.max("p").alias("p")).join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = joined(fresh, classes, "sketch", "n")
        return map_arrow(found.select("a", "b", "p", F.col("x_sketch").alias("x"), F.col("y_sketch").alias("y"), F.col("x_n").alias("nx"), F.col("y_n").alias("ny")),
                         _bounds, "a long, b long, p long, near double")

    # a pair is due in the region of its first shared shingle: none lies before it, so both sets must have enough left from there on
    due = F.expr(f"{PLACES} * 75L * (n + n2) <= 175 * least(n * ({PLACES}L - at), n2 * ({PLACES}L - at2))")
    # and sets that link differ in a seventh of both at most, so their parities do
    due = due & F.expr("175L * (" + " + ".join(f"bit_count({w} ^ {w}2)" for w in _PARITIES) + ") <= 25L * (n + n2)")

    def leaf_pairs(leaf: DataFrame) -> DataFrame:
        other = leaf.select("h", *(F.col(c).alias(f"{c}2") for c in ("cls", "n", "at", "comp", *_PARITIES)))
        return leaf.join(other, "h").where("cls < cls2 and comp <> comp2").where(due).select(*pair("cls", "n", "cls2", "n2"))

    hashed = docs.select("text", F.xxhash64("doc_id").alias("k")).select("text", "k", F.xxhash64("k").alias("kk"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the classes of some pairs, and of few others, stored by class."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        texts = spool(classes.select("cls", "doc").join(needed, "cls", "left_semi").select(F.xxhash64("doc").alias("k")), "wanted")
        wanted = spark.sparkContext.broadcast(bloom_filter(texts, "k", texts.count()))
        stored = bucketed(map_arrow(hashed, _sets(words, wanted), "cls long, hashes binary").repartition(parts, "cls"), "cls", parts, "sets")
        wanted.destroy()
        return stored

    def measure(pairs: DataFrame) -> DataFrame:
        """The known (a, b, near, far) and those of more pairs: the distance where the lower bound leaves a link open, else the bound."""
        pairs = spool(bounded(pairs), "pairs")
        open_ = pairs.where(F.col("near") <= r)
        ruled_out = pairs.where(F.col("near") > r).select("a", "b", "near", F.lit(1.0).alias("far"))
        found = joined(open_.select("a", "b", "p"), sets_of(open_), "hashes")
        counted = map_arrow(found.select("a", "b", F.col("x_hashes").alias("x"), F.col("y_hashes").alias("y")), _distances, "a long, b long, common int, total int")
        # the threshold is decided in whole numbers
        d = 1 - F.col("common") / F.col("total")
        d = F.when(F.col("common") * 100 >= F.col("total") * 75, F.least(F.lit(r), d)).otherwise(F.greatest(F.lit(r + eps), d))
        exact = counted.distinct().select("a", "b", d.alias("near"), d.alias("far"))
        return spool(known.union(exact).union(ruled_out), "distances")

    def connected() -> DataFrame:
        return connected_components(known.where(F.col("far") <= r).select("a", "b"), "joined")

    def grouped(region: DataFrame) -> DataFrame:
        """Regions that are not connected yet, with their documents' components and the largest one of each."""
        region = (region.drop("comp").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
                  .withColumn("comp", F.coalesce("comp", "cls")))
        sizes = region.groupBy("h", "comp").agg(F.count("*").alias("m")).groupBy("h").agg(
            F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("top"))
        sizes = sizes.select("h", "size", F.col("top.comp").alias("main"), (F.col("size") - F.col("top.m")).alias("outer"))
        return region.join(sizes.where("outer > 0"), "h")

    # every document and the pivot of its regions: this connects most groups of copies, whatever their size
    known = unknown
    known = measure(region.where("100 * lo >= 75 * hi").select(*pair("cls", "n", "centre", "nc")))
    comps, most, turn = connected(), LEAF, 0
    region = (region.withColumns({"a": F.least("cls", "centre"), "b": F.greatest("cls", "centre")}).join(known, ["a", "b"], "left")
              .select("h", "cls", "n", "at", F.coalesce("near", 1 - F.col("lo") / F.col("hi")).alias("near"), F.coalesce("far", F.lit(1.0)).alias("far"), F.col("cls").alias("comp"))
              .join(classes.select("cls", *_PARITIES), "cls"))
    while True:
        region = spool(grouped(region), "regions")
        if region.isEmpty():
            break
        # a document goes on if the triangle inequality over the centre lets it link with one of another part of its region
        outside = F.col("comp") != F.col("main")
        window = region.groupBy("h").agg(F.min(F.when(outside, F.col("near"))).alias("lo"), F.max(F.when(outside, F.col("far"))).alias("hi"))
        region = region.join(window, "h").where(outside | ((F.col("far") >= F.col("lo") - r - eps) & (F.col("near") <= F.col("hi") + r + eps))).drop("lo", "hi")
        leaf, big = region.where(F.col("size") <= most), region.where(F.col("size") > most)
        columns = ("cls", "n", "at", "comp", "near", "far", *_PARITIES)
        # those of the least hashes, so that regions of one group mostly share them
        some = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(1 << 20)) * F.col("outer") < (OUTER_PIVOTS * 8**turn) << 20
        inner = big.where(~outside).groupBy("h").agg(F.array_distinct(F.array(*(F.min_by(F.struct(*columns), F.xxhash64("cls", F.lit(turn * INNER_PIVOTS + i)))
                                                                                for i in range(INNER_PIVOTS)))).alias("p"))
        pivots = big.where(outside & some).select("h", *columns).union(inner.select("h", F.inline("p")))
        pivots, turn = spool(pivots.toDF("h", *(f"{c}2" for c in columns)), "pivots"), turn + 1
        star = (big.join(pivots, "h").where("cls <> cls2 and comp <> comp2")
                .where((F.col("near") <= F.col("far2") + r + eps) & (F.col("near2") <= F.col("far") + r + eps))
                .where(due).select(*pair("cls", "n", "cls2", "n2")))
        known = measure(leaf_pairs(leaf).union(star))
        comps, most = connected(), min(2 * most, LAST_LEAF)
        region = big.join(pivots.select("h", F.col("cls2").alias("cls")), ["h", "cls"], "left_anti").select("h", *columns)

    root = classes.select("cls", "doc").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = root.groupBy("comp").agg(F.min("doc").alias("component_id"))
    label = root.join(smallest, "comp").select("cls", "component_id")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    linked = sets.join(label, "cls", "left")
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
