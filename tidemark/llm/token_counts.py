"""Token counts through a cache keyed by content and tokenizer digests.

Content is normalised (null becomes the empty text, nothing else, since every other change could change
the count) and digested by SHA-256; the tokenizer's digest is that of its file. Known digests are joined
to their stored counts. One row stands for each digest that is not known; a Bloom filter of bounded size
lets these rows through to the encoder without moving any text, and a join drops what passed by chance.
The new counts are appended to the cache, which is then joined to all rows.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows are kept; equal texts are
encoded once. Rows without doc_id are counted too. Other columns are not read. An empty table gives no rows, and
texts of any length are read whole. A count that a lost or
repeated job has stored twice is read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import bloom_filter, bloom_has, map_arrow, pieces_of, spool
from tidemark.llm.tokens import byte_counts

_CACHE = "tokenizer string, digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer."""
    try:
        stored = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], _CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs (doc_id, text); ``cache`` is a folder of the shared store."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    content = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    content = content.withColumn("digest", F.sha2("text", 256)).withColumn("k", F.xxhash64("digest", F.coalesce("doc_id", F.lit(-1))))
    known = spool(content.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", "k"), "digests")
    missing = known.groupBy("digest").agg(F.min("k").alias("k")).join(cached_counts(spark, cache, version), "digest", "left_anti")
    missing = spool(missing, "not-cached")
    count = missing.count()
    if count:
        wanted = spark.sparkContext.broadcast(bloom_filter(missing, "k", count))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = byte_counts(tokenizer)
            for batch in batches:
                keys = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "kk")]
                for piece in pieces_of(batch.filter(pa.array(bloom_has(wanted.value, *keys)))):
                    numbers = [counter.count(t) for t in piece.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([piece.column("digest"), pa.array(numbers, pa.int64())], ["digest", "n_tokens"])

        rows = content.select("text", "digest", "k", F.xxhash64("k").alias("kk"))
        fresh = map_arrow(rows, encode, "digest string, n_tokens long", holds=True).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        (fresh.join(missing.select("digest"), "digest", "left_semi").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
         .write.mode("append").parquet(cache))
    return known.join(cached_counts(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens")
