"""What several operators share: word boundaries and hashes in numpy, Bloom filters, connected components."""

from __future__ import annotations

import pathlib
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import fresh_path, spool

__all__ = ["arrow_type", "bloom_filter", "bucketed", "connected_components", "free_name", "fresh_path", "give_back", "hash_words", "held", "let_go", "map_arrow", "mix64", "partitions", "pieces_of", "ship",
           "spool", "text_bytes", "word_bounds", "words_per_row"]

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back to the system when a batch is done
#: Rows that Spark hands to a Python task at a time; long texts would else make batches of many megabytes.
BATCH_ROWS = 1_000
#: Text handled at a time inside a task, which bounds its temporary arrays.
PIECE_BYTES = 1 << 20
#: Bits of the largest Bloom filter that is sent to the tasks (8 MB).
BLOOM_BITS = 1 << 26

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_CODE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def pieces_of(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text; a longer row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and the places where rows begin, with the end of the last; null is empty."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word ``[^\\x20\\x09-\\x0D]+``; a word never spans two rows."""
    inside = ~_SPACE[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    cut[:-1] |= ~inside
    before = np.empty_like(inside)
    before[0] = True
    before[1:] = ~inside[:-1]
    cut_before = before | cut[:-1]
    return np.flatnonzero(inside & cut_before), np.flatnonzero(inside & cut[1:]) + 1


def words_per_row(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(starts, rows))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have) <= n:
        size = max(PIECE_BYTES + 1, n + 1)
        for key, base in ((0, _BASE), (1, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z in lower case."""
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[_LOWER[data]] * power[:len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def arrow_type(schema: str) -> pa.Schema:
    """The Arrow schema that Spark uses for a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def bloom_filter(keys: DataFrame, key: str, rows: int) -> np.ndarray:
    """Words of a Bloom filter over a column of 64-bit hashes: at most ``BLOOM_BITS``, whatever the rows.

    The bits are joined by Spark. A filter too small for its keys lets more rows pass and loses none.
    """
    bits = min(BLOOM_BITS, max(1 << 12, 1 << (16 * max(rows, 1) - 1).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    place = F.explode(F.array(F.shiftrightunsigned(F.col(key), shift),
                              F.shiftrightunsigned(F.xxhash64(F.col(key)), shift))).alias("p")
    words = (keys.select(place).select(F.shiftright("p", 6).alias("w"),
                                       F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    out = np.zeros(max(1, bits >> 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out


def bloom_has(words: np.ndarray, key: np.ndarray, rehashed: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; ``rehashed`` is Spark's ``xxhash64`` of the key."""
    shift = np.uint64(64 - ((len(words) << 6).bit_length() - 1))
    found = np.ones(len(key), bool)
    for k in (key, rehashed):
        p = k.view(np.uint64) >> shift
        found &= (words.view(np.uint64)[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp) for every node that is not the smallest of its component; comp is that smallest node.

    Alternating stars: each round ties a node's larger neighbours, then its smaller ones, to the
    smallest node it knows. Every round is written out, so a lost executor costs one round at most.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, seen = spool(edges, label), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a")
        edges = spool(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .union(small.select("a", F.col("m").alias("b"))).distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        seen = now


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per session; no installation on them is needed."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    path = f"{context._temp_dir}/tidemark.zip"  # the driver's own folder, from which Spark copies it to each worker
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context._tidemark_shipped = True


#: The model that this worker process holds for further tasks, by its key.
_HELD: dict[Hashable, object] = {}


def held(key: Hashable, load: Callable[[], object]) -> object:
    """A model loaded once a worker process, until another one or a task without any takes its place."""
    if key not in _HELD:
        let_go()
        _HELD[key] = load()
        give_back()
    return _HELD[key]


def let_go() -> None:
    if _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Memory that was freed goes back to the system: else a worker keeps as much as its largest task or load ever took."""
    pa.system_memory_pool().release_unused()


def map_arrow(df: DataFrame, function: Callable, schema, holds: bool = False) -> DataFrame:
    """``mapInArrow`` whose function may use this package.

    Worker processes serve the tasks of one operator after another. A function that ``holds`` no model lets go of the one
    that an operator before it left, and gives back at its end what it took; both would else add to the memory of all that follow.
    """
    ship(df.sparkSession)

    def alone(batches):
        let_go()
        yield from function(batches)
        give_back()

    return df.mapInArrow(function if holds else alone, schema)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that no column of the frame has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bucketed(df: DataFrame, key: str, parts: int, label: str) -> DataFrame:
    """A stored table whose rows lie by the hash of ``key`` in ``parts`` buckets; ``df`` must be dealt out like that.

    Joins and groupings by the key then leave it where it is.
    """
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", fresh_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
