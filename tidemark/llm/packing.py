"""Bounded-space online best-fit packing of token sequences.

Each task keeps a fixed number of open bins. A bitset has a bit for each free space some open bin has,
so the tightest bin that still fits is one shift away; when a bin must be opened and all are in use, the
fullest closes. Bins that a task leaves partly filled are packed once more as whole items, largest first,
by fewer tasks, which brings the waste down to that of a few open bins.

Defined results: null and empty texts are documents of the end id alone. Only documents longer than the
capacity are cut. Rows of one doc_id are documents of their own. An empty table gives no rows. Other columns are not read. Which
sequence a piece goes to depends on the partitions of the input; the placement is written out once, so a
lost executor cannot leave two versions of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import arrow_type, map_arrow, pieces_of, spool
from tidemark.llm.tokens import word_ids

#: Open bins of a task.
OPEN_BINS = 256
#: Bins filled less than this share of the capacity are packed again, this many to a task.
REPACKED, REPACKED_PER_TASK = 0.97, 50_000


class BestFit:
    """Open bins by free space."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS, first: int = 0):
        self.capacity, self.most, self.next, self.held = capacity, open_bins, first, 0
        self.spaces = 0  # bit f: an open bin has f free
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        found = bins.pop()
        if not bins:
            self.spaces &= ~(1 << free)
        self.held -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for an item of 1 to ``capacity``."""
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.next
            self.next += 1
            if self.held >= self.most and length < self.capacity:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        if left := free - length:
            self.bins.setdefault(left, []).append(at)
            self.spaces |= 1 << left
            self.held += 1
        return at, self.capacity - free


def _first_bin() -> int:
    return TaskContext.get().partitionId() << 36


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ``ids`` (binary) if asked for.

    A document is its ids by the tokenizer file, without special tokens added, and ``end_id``.
    """
    end = int(end_id).to_bytes(4, "little")
    shape = ("doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long"
             + ", ids binary" * with_ids)
    out = arrow_type(shape)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, encoder = BestFit(capacity, open_bins, _first_bin()), word_ids(tokenizer)
        for batch in batches:
            for part in pieces_of(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = (encoder.encode(text) if text else b"") + end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s:s + 4 * capacity]
                        rows.append((doc, k, s // 4, len(own) // 4, zlib.crc32(own), *bins.place(len(own) // 4), *[own] * with_ids))
                columns = zip(*rows) if rows else [[]] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    placed = spool(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), place, shape, holds=True), "pieces")
    fills = placed.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < int(REPACKED * capacity))
    fills = spool(fills, "partly-filled")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins, -1 - _first_bin() - (1 << 35))
        for batch in batches:
            spots = [bins.place(n) for n in batch.column("fill").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bin"), pa.array([s for s, _ in spots], pa.int64()),
                                              pa.array([b for _, b in spots], pa.int64())], ["bin", "seq", "base"])

    tasks = 1 + fills.count() // REPACKED_PER_TASK
    dealt = fills.repartition(tasks, "bin").sortWithinPartitions(F.desc("fill"), "bin")
    moved = spool(map_arrow(dealt, again, "bin long, seq long, base long"), "moved-bins")
    return (placed.join(moved, "bin", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("seq", "bin").alias("sequence_id"),
                    (F.coalesce("base", F.lit(0)) + F.col("at")).alias("offset"), *["ids"] * with_ids))
