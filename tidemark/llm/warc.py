"""WARC archives of pages: writing, reading back, and a merged index of captures.

Records are written by Spark's text writer, whose line separator is the end of a WARC record, into
gzip files of a bounded number of records. Of records with equal payloads one holds the payload and the
others refer to it. Reading streams through each file and recomputes every digest it can. A file's captures,
sorted by url key, time and page, are a run; runs are cut at common key bounds, and each range merges its
parts of the runs with a tree of losers, so that the ranges together are one ordered history.

Defined results: null html is an empty payload, a null url an empty target. Pages without page_id are
revisits if a page with an id has their payload, else responses. Rows of one page_id and payload are
responses alike. Repeated rows are kept. Other columns are not read. An empty table
gives no rows, and a payload of any length is written whole. Pages have no capture time, so it is
``EPOCH`` plus page_id seconds.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import map_arrow, pieces_of, spool

#: Records of a file at most, which bounds what a reading task holds of it (compressed).
RECORDS_PER_FILE = 2_000
EPOCH, SECONDS = dt.datetime(2020, 1, 1), 1_000_000_000
END = "\r\n\r\n"
_ID = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_time(page: int | None) -> str:
    return (EPOCH + dt.timedelta(seconds=(page or 0) % SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, so that a site's captures are neighbours."""
    host, slash, rest = url.partition("://")[2].partition("/")
    host = host.lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){slash}{rest}"


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool) -> str:
    """One record without its end."""
    head = _HTTP.format(len(payload))
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_ID}{'' if page is None else page}>"),
              ("WARC-Date", capture_time(page)),
              ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}")]
    if revisit:
        fields += [("WARC-Refers-To", f"<{_ID}{refers}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head) + (0 if revisit else len(payload))))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + head + ("" if revisit else payload.decode())


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html); payloads of fewer bytes are never revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    small = rows.where(F.octet_length("html") >= revisit_from).select("page_id", "digest")
    first = small.groupBy("digest").agg(F.max("page_id").alias("refers")).where("refers is not null")
    # only the pages that refer to another one are joined to the payloads; they are few or Spark shuffles them
    revisits = spool(small.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers"))).distinct()
                     .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers"), "revisits")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", F.col("html").alias("text"), "refers")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                lines = [record(page, url, html.encode(), refers, refers is not None)
                         for page, url, html, refers in zip(*(c.to_pylist() for c in piece.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    (map_arrow(rows, records, "value string").write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def records_in(file) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of each record of an open file, by the lengths that the records state."""
    while line := file.readline():
        at = file.tell() - len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.decode().lower()] = value.decode().strip()
        size = int(fields["content-length"])
        block = file.read(size)
        if len(block) != size or file.read(4) != END.encode():
            raise ValueError(f"cut record at byte {at}")
        yield at, file.tell() - at, fields, block


_INDEX = ("run string, url_key string, captured string, page_id long, record_type string, refers_to long, payload_digest string,"
          " payload_bytes long, offset long, length long")
_COLUMNS = [c.split()[0] for c in _INDEX.split(",")]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each file, one sorted run per file; stated digests and lengths are checked on the way."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(text: str) -> int | None:
            number = text.strip("<>").removeprefix(_ID)
            return int(number) if number else None

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                run = []
                with gzip.open(io.BytesIO(content.as_buffer())) as file:
                    for at, length, fields, block in records_in(file):
                        head, _, payload = block.partition(END.encode())
                        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (digest_of(payload), len(payload)) != (digest, size):
                            raise ValueError(f"payload does not match its digest: {name} at byte {at}")
                        refers = fields.get("warc-refers-to")
                        run.append((name, url_key(fields["warc-target-uri"]), fields["warc-date"], page(fields["warc-record-id"]), fields["warc-type"],
                                    page(refers) if refers else None, digest, size, at, length))
                run.sort(key=_order)
                for s in range(0, len(run), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i in (0, 1, 2, 4, 6) else pa.array(c, pa.int64())
                                                      for i, c in enumerate(zip(*run[s:s + 2000]))], _COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return map_arrow(files, captures, _INDEX)


def _order(row: Sequence) -> tuple:
    """Url key, time, page, then place."""
    return row[1], row[2], -1 if row[3] is None else row[3], row[0], row[8]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: Sequence[Sequence], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.head = [None] * len(runs)
        self.keys: list = [None] * len(runs)
        for i in range(len(runs)):
            self._next(i)
        self.tree = [-1] * max(len(runs), 1)
        for i in reversed(range(len(runs))):
            self._replay(i)

    def _next(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.keys[i] = None if self.head[i] is None else (self.key(self.head[i]), i)

    def _beats(self, i: int, j: int) -> bool:
        """-1 stands for a match not played yet and beats all; a run that has ended loses to all."""
        if i < 0 or j < 0:
            return i < 0
        if self.keys[i] is None or self.keys[j] is None:
            return self.keys[j] is None and self.keys[i] is not None
        return self.keys[i] < self.keys[j]

    def _replay(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node:
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and self.head[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.head[winner]
            self._next(winner)
            self._replay(winner)


def capture_history(runs: DataFrame) -> DataFrame:
    """All captures in one order by url key, time and page: ordered inside each partition and from one to the next."""
    ranged = runs.repartitionByRange("url_key", "captured", "page_id", "run", "offset").sortWithinPartitions("run", "url_key", "captured", "page_id", "offset")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        shape = None
        for batch in batches:
            shape = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(row[0], []).append(row)
        held = []
        for row in LoserTree(list(parts.values()), _order):
            held.append(row)
            if len(held) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)

    return map_arrow(ranged, merge, _INDEX)
