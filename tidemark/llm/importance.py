"""Resampling documents towards a target distribution of hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks all other ASCII but digits and letters, straight in UTF-8, so that
``bytes.split`` yields the words. A feature is a run of 1 to ``N_GRAM`` words joined by one space; its CRC-32 takes the
CRC of the run without its last word as the seed, so no joined text is ever built. The CRC modulo ``BUCKETS`` is the feature's
bucket. Tasks reduce their features to a ``Counter`` by bucket, so at most ``BUCKETS`` rows a task are shuffled, whatever its
texts hold. The gains, one whole number per bucket, are the only thing sent back to the tasks; a document's weight is the sum
over its features, and a Gumbel draw by its doc_id turns the highest scores into a sample without replacement.

Ranks are places in a distributed sort: the number of a row inside its sorted partition plus the rows of all
partitions before it, so no single task sees all documents.

Defined results: a null or empty text, or one without words, has no features and weight 0; it is scored and never
drawn. A text of any length is read in pieces cut at separators. Rows that share a doc_id share the draw and are
documents of their own; a row without doc_id draws as the empty id and comes last in ties. Further ties go by features, weight
and a hash of the text. Of an empty target or corpus the gains are those of counts of 0. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import arrow_type, map_arrow, pieces_of, spool

BUCKETS, N_GRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Text split into words at a time, so that a very long one is never a list of all its words.
PIECE = 1 << 20
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_ID_BITS = 33  # Spark's row numbers: the partition above, the place inside it below


def _table() -> bytes:
    table = bytearray(range(256))
    for b in _SEPARATORS:
        table[b] = 0x20
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    return bytes(table)


_TABLE = _table()


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; pieces end at separators, so no word is cut."""
    at = 0
    while at < len(text):
        cut = _SEPARATOR.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = cut.start() if cut else len(text)
        yield text[at:to].translate(_TABLE).split()
        at = to


def feature_crcs(text: bytes, n_gram: int = N_GRAM) -> Iterator[tuple[int, list[list[int]]]]:
    """(new words, CRCs of the runs of 1, 2, ... words that end in them), a piece at a time."""
    before: list[bytes] = []
    for new in _word_lists(text):
        words = before + new
        later = list(map(b" ".__add__, words))
        crcs, runs = list(map(zlib.crc32, words)), []
        for length in range(1, n_gram + 1):
            if length > 1:
                crcs = list(map(zlib.crc32, later[length - 1:], crcs))
            runs.append(crcs[max(len(before) - length + 1, 0):])  # the others ended in the piece before
        yield len(new), runs
        before = words[max(len(words) - n_gram + 1, 0):]


def _buckets(runs: list[list[int]], buckets: int) -> np.ndarray:
    n = sum(map(len, runs))
    return (np.fromiter(chain.from_iterable(runs), np.uint32, n) % np.uint32(buckets)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for piece in pieces_of(batch):
        for text in piece.column("text").cast(pa.large_binary()):
            yield text.as_py() or b""


def _count(buckets: int, n_gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            for text in _texts(batch):
                for _, runs in feature_crcs(text, n_gram):
                    found.update(_buckets(runs, buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, n_gram: int = N_GRAM) -> DataFrame:
    """(bucket, n) of all features of a column ``text``; buckets without features have no row."""
    counted = map_arrow(texts.select(F.col("text").cast("string").alias("text")), _count(buckets, n_gram), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket adds to a weight: floor(1000 ln of its smoothed ratio of shares)."""
    def dense(counts: DataFrame) -> np.ndarray:
        rows, out = counts.toPandas(), np.zeros(buckets, np.int64)  # at most one row per bucket
        out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
        return out

    s, t = dense(corpus), dense(target)
    ratio = ((t + 1).astype(float) * float(t.size + s.sum())) / ((s + 1).astype(float) * float(t.size + t.sum()))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigh(gain: np.ndarray, n_gram: int, shape: pa.Schema):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            for text in _texts(batch):
                w = f = total = 0
                for n, runs in feature_crcs(text, n_gram):
                    at = _buckets(runs, len(gain))
                    w, f, total = w + n, f + len(at), total + int(gain[at].sum())
                words.append(w)
                features.append(f)
                weight.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), *(pa.array(c, pa.int64()) for c in (words, features, weight))],
                                             schema=shape)

    return weigh


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a u in (0, 1) from the first 32 bits of sha256(``seed:doc_id``)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
                        seed: int = SEED, buckets: int = BUCKETS, n_gram: int = N_GRAM) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for each row of docs (doc_id, text); ``rank`` is null if not drawn.

    ``floor(percent * N / 100)`` of the N documents of at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs, buckets, n_gram), bucket_counts(target, buckets, n_gram), buckets)
    shape = "doc_id long, tie long, n_words long, n_features long, weight long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    weighed = map_arrow(rows, _weigh(gain, n_gram, arrow_type(shape)), shape)
    scored = spool(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance-scores")
    long_enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "tie"]
    placed = spool(scored.where(long_enough).orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("place", _ID_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition of the sort
    first = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    drawn = placed.agg((F.floor(F.count("*") * percent / 100)).alias("drawn")).scalar()
    rank = F.col("first") + F.col("place").bitwiseAND((1 << _ID_BITS) - 1) + 1
    ranked = placed.withColumn("part", part).join(first, "part").withColumn("rank", F.when(rank <= drawn, rank))
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(*out).union(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")).select(*out))
