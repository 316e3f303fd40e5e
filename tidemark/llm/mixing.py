"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

A source whose target is k whole sizes and a rest takes every document k times (complete epochs) and
the rest by sampling: each document draws a key, an exponential variate divided by its quality weight,
and the smallest keys are taken until their running sum of words meets the rest. The document at the
edge gives its leading words, so a source takes its target up to a fraction of a word.

The running sum needs no sorted source in one task: keys are put into ``KEY_CELLS`` cells, the cells
of a source are summed ahead of the shuffle, and only the one cell where the sum crosses the budget
is sorted. The cells are narrow for the small keys of good documents as for the long tail that a low quality gives, so a source
of any quality is spread over thousands of them.

Defined results: null and empty texts have size 0 and take 0; a source of such rows only has target 0.
A null source is a source of its own, last in the order. Equal keys (rows of one doc_id) go by id,
then size, then a hash of the text. Draws depend on seed and doc_id, on the hash of the text for rows without one, so reruns agree.
Repeated rows count as often as they occur. Rows that share a doc_id and not the text have decisions of their own. An empty table
gives no rows, and very long texts are measured and cut one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import free_name, map_arrow, pieces_of, spool, text_bytes, word_bounds, words_per_row

#: Cells that the keys of a source are summed in; the one at the edge is sorted.
KEY_CELLS = 4096
#: Least quality weight, so that no document is out of reach.
LEAST_WEIGHT = 0.05

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tie, size, quality): words of the whole text, and the share of letters in its words; a hash of the text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                data, rows = text_bytes(piece.column("text"))
                starts, ends = word_bounds(data, rows)
                size = words_per_row(starts, rows)
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[rows]
                length = np.concatenate([[0], np.cumsum(ends - starts)])[np.concatenate([[0], np.cumsum(size)])]
                quality = np.maximum(np.diff(letters) / np.maximum(np.diff(length), 1), LEAST_WEIGHT)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("source").cast(pa.string()), piece.column("tie"),
                                                  pa.array(size, pa.int64()), pa.array(quality)], ["doc_id", "source", "tie", "size", "quality"])

    return map_arrow(docs.select("doc_id", F.col("source").cast("string"), F.col("text").cast("string"), text_hash().alias("tie")), measure,
                     "doc_id long, source string, tie long, size long, quality double")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all words, by weight, at most ``most`` times a source.

    Weights repeat over the sources in code point order, null last. What a full source leaves goes to
    the others by weight: target = min(most * size, level * weight) with one level for all, found by
    running sums over the sources in the order in which they fill up.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # code points and UTF-8 bytes sort alike; the windows see one row per source
    at = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (at % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    per = per.withColumns({"total": share * F.sum("source_size").over(W.partitionBy()),
                           "full": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
                           "open": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))})
    # the level if this source and all that fill up later are still open; right for the first that it leaves open
    level = (F.col("total") - F.col("full")) / F.col("open")
    fits = level * F.col("weight") <= F.col("cap")
    chosen = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), level.alias("level")))).over(W.partitionBy())
    per = per.withColumn("level", chosen["level"])
    return per.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap"))
                      .otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def sampling_key(seed: int, quality: Column) -> Column:
    """Exponential variate over the weight; the smallest keys are a weighted sample without replacement."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", "tie")), 11).cast("double")
    return -F.log((bits + 0.5) / float(1 << 53)) / quality


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, epochs, taken), a row per row of docs; ``tie`` is a hash of the text."""
    sizes = spool(measured(docs).withColumn("k", sampling_key(seed, F.col("quality"))), "mix-sizes")
    target = spool(source_targets(sizes, weights, share, most), "mix-targets")
    whole = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    target = target.withColumn("epochs", epochs.cast("long")).withColumn("rest", (whole - F.col("epochs") * F.col("source_size")).cast("long"))
    # a key is an exponential variate of mean 1 to 1 / LEAST_WEIGHT: half of the cells follow either end, and both rise with the key
    spread = 2 - F.exp(-F.col("k")) - F.exp(-F.col("k") * LEAST_WEIGHT)
    cell = F.least(F.floor(F.lit(KEY_CELLS / 2) * spread), F.lit(KEY_CELLS - 1)).cast("int")
    sizes = sizes.withColumn("cell", cell)
    cells = sizes.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(W.partitionBy("source").orderBy("cell")) - F.col("words")
    edge = (cells.withColumn("before", before).alias("c").join(target.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
            .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
            .select(F.col("t.source").alias("source"), "cell", "before"))
    target = (target.alias("t").join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
              .select("t.*", F.coalesce("cell", F.lit(KEY_CELLS)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
              .withColumnRenamed("source", "of"))
    target = spool(target, "mix-edges")
    rows = sizes.join(target, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = W.partitionBy("source").orderBy("k", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    below = rows.where("cell < edge").withColumn("part", F.col("size"))
    above = rows.where("cell > edge").withColumn("part", F.lit(0).cast("long"))
    at = rows.where("cell = edge").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at = at.withColumn("part", F.least("size", F.greatest(F.col("rest") - F.col("ahead"), F.lit(0)))).drop("ahead")
    return (below.unionByName(above).unionByName(at)
            .select("doc_id", "source", "tie", "size", "source_size", "target", "epochs",
                    (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")))



def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The documents of the mix, a row for each epoch that takes one; the one at a source's edge is cut to its share.

    Rows equal in doc_id, source and text share one decision, that of the one taken most. Documents without words are not in the mix.
    """
    names, schema = docs.columns, docs.schema
    of, source, tie, total, size, words = (free_name(docs, n) for n in ("_of", "_source", "_tie", "_total", "_size", "_words"))
    plan = mix(docs, weights, share, most, seed).where("taken > 0").groupBy("doc_id", "source", "tie").agg(F.max(F.struct("taken", "size")).alias("m"))
    plan = plan.select(F.col("doc_id").alias(of), F.col("source").alias(source), F.col("tie").alias(tie), F.col("m.taken").alias(total), F.col("m.size").alias(size))
    epochs = F.sequence(F.lit(0), F.ceil(F.col(total) / F.col(size)).cast("int") - 1)
    same = ((F.col("doc_id").cast("long").eqNullSafe(F.col(of))) & (F.col("source").cast("string").eqNullSafe(F.col(source)))
            & (text_hash() == F.col(tie)))
    rows = docs.join(plan, same).withColumn(
        words, F.explode(F.transform(epochs, lambda k: F.least(F.col(size), F.col(total) - k * F.col(size)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            columns, at = list(batch.columns), names.index("text")
            short = np.flatnonzero(batch.column(words).to_numpy() < batch.column(size).to_numpy())
            if len(short):
                cuts = {}
                for i in short.tolist():
                    text, end = columns[at][i].as_py() or "", 0
                    for _, m in zip(range(batch.column(words)[i].as_py()), word.finditer(text)):
                        end = m.end()
                    cuts[i] = text[:end] if end else text
                columns[at] = pa.array([cuts[i] if i in cuts else columns[at][i].as_py() for i in range(len(columns[at]))], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns[:len(names)], names)

    out = map_arrow(rows.select(*docs.columns, words, size), cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
