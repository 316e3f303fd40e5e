"""Quality by a byte-level convolutional network in numpy.

A text is covered whole by overlapping chunks of bytes. Learned filters slide over each chunk; the
strongest response of each filter in a chunk is kept (max-pooling), averaged over the chunks of the
text and combined into one probability. Besides the byte itself, a position tells whether its last eight
bytes occurred in the chunk before, which no filter of fixed weights could compare.

Defined results: null and empty texts are one chunk of padding. Without labels of both kinds every score
is the share of good labels, 0.5 without any, and an empty table gives no rows. Texts of any length are read whole, in
training as in scoring. Equal texts get equal scores. Other columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import PIECE_BYTES, let_go, map_arrow, pieces_of, ship, text_bytes

#: Bytes of a chunk, bytes from one chunk to the next, filters, filter width, bytes between filter places.
CHUNK, STEP, FILTERS, WIDTH, STRIDE = 512, 448, 12, 7, 2
#: Bound of the fit: labelled rows, each read whole.
MAX_EXAMPLES = 4_000
#: Chunks that go through the filters at a time.
_TOGETHER = 512
#: The same work whatever the sample: steps of gradient descent, and rows of each.
STEPS, BATCH, EMBED, SEED = 500, 48, 6, 7
PAD, RECUR = 256, 8


def chunks_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all rows, padded, and each row's first chunk (with the end)."""
    sizes = np.diff(rows)
    count = np.maximum(1, -(-np.maximum(sizes - (CHUNK - STEP), 0) // STEP))
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(sizes)), count)
    begin = (np.arange(first[-1]) - first[row]) * STEP
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < sizes[row][:, None]
    at = np.where(inside, at + rows[row][:, None], 0)
    taken = data[at].astype(np.int16) if len(data) else np.zeros(at.shape, np.int16)
    return np.where(inside, taken, PAD).astype(np.int16), first


def recurs(chunks: np.ndarray) -> np.ndarray:
    """Whether the eight bytes from a place on occur earlier in the chunk."""
    n = chunks.shape[1] - RECUR + 1
    gram = np.zeros((len(chunks), n), np.uint64)
    for j in range(RECUR):
        gram = gram * np.uint64(0x9E3779B97F4A7C15 | 1) + chunks[:, j:j + n].astype(np.uint64) + np.uint64(1)
    gram = (gram & ~np.uint64(0x3FF)) | np.arange(n, dtype=np.uint64)  # the place in the low bits keeps the sort stable
    gram.sort(axis=1)
    again = np.zeros((len(chunks), n), bool)
    again[:, 1:] = (gram[:, 1:] >> np.uint64(10)) == (gram[:, :-1] >> np.uint64(10))
    out = np.zeros(chunks.shape, np.float32)
    np.put_along_axis(out, (gram & np.uint64(0x3FF)).astype(np.int64), again.astype(np.float32), axis=1)
    return np.where(chunks == PAD, np.float32(0), out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class ByteNet:
    """Embedding of bytes, one layer of filters, max-pooling by chunk, mean over chunks, logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.5, (PAD + 1, EMBED)).astype(np.float32),
                  "filters": rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)).astype(np.float32),
                  "recur": rng.normal(0, 0.25, (WIDTH, FILTERS)).astype(np.float32),
                  "shift": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.3, FILTERS).astype(np.float32),
                  "bias": np.zeros(1, np.float32)}
        self.p["embed"][PAD] = 0
        self.constant: float | None = None

    def respond(self, chunks: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest response of each filter in each chunk, and its place."""
        tables = np.einsum("be,wef->wbf", self.p["embed"], self.p["filters"])
        places = range(0, chunks.shape[1] - WIDTH + 1, STRIDE)
        n = len(places)
        total = np.tile(self.p["shift"], (len(chunks), n, 1))
        for j in range(WIDTH):
            part = slice(j, j + (n - 1) * STRIDE + 1, STRIDE)
            total += tables[j][chunks[:, part]]
            total += again[:, part, None] * self.p["recur"][j]
        at = total.argmax(axis=1)
        return np.maximum(np.take_along_axis(total, at[:, None], axis=1)[:, 0], 0), at

    def probability(self, chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One probability for each row of chunks."""
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        pooled = np.concatenate([self.respond(c, recurs(c))[0] for c in np.array_split(chunks, -(-len(chunks) // 256))])
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
        return _sigmoid(mean @ self.p["out"] + self.p["bias"][0]).astype(float)

    def fit(self, chunks: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """A fixed number of Adam steps on rows drawn with replacement."""
        rng, again = np.random.default_rng(seed), np.concatenate([recurs(c).astype(bool) for c in np.array_split(chunks, -(-len(chunks) // 256))])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        count = np.diff(first)
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(labels), BATCH)
            own = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            group = np.repeat(np.arange(BATCH), count[rows])
            c, a = chunks[own], again[own]
            answers = [self.respond(c[i:i + _TOGETHER], a[i:i + _TOGETHER]) for i in range(0, len(c), _TOGETHER)]
            pooled, at = (np.concatenate(x) for x in zip(*answers))
            share = (1 / count[rows])[group][:, None]
            mean = np.zeros((BATCH, FILTERS))
            np.add.at(mean, group, pooled * share)
            d = (_sigmoid(mean @ self.p["out"] + self.p["bias"][0]) - labels[rows]) / BATCH
            g = {"out": mean.T @ d, "bias": np.array([d.sum()])}
            back = (d[group][:, None] * share * self.p["out"]) * (pooled > 0)
            g["shift"], g["filters"] = back.sum(0), np.zeros_like(self.p["filters"])
            g["recur"], g["embed"] = np.zeros_like(self.p["recur"]), np.zeros_like(self.p["embed"])
            here = np.arange(len(c))[:, None]
            for j in range(WIDTH):
                seen = c[here, at * STRIDE + j]
                e = self.p["embed"][seen]
                g["filters"][j] = np.einsum("nf,nfe->ef", back, e)
                g["recur"][j] = (back * a[here, at * STRIDE + j]).sum(0)
                np.add.at(g["embed"], seen, back[:, :, None] * self.p["filters"][j].T[None])
            g["embed"][PAD] = 0
            rate = 0.02 * (1 - 0.9 * step / steps)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v2[k] = 0.999 * v2[k] + 0.001 * x * x
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def fit_quality(docs: DataFrame, labelled: DataFrame, max_examples: int = MAX_EXAMPLES, steps: int = STEPS) -> ByteNet:
    """Learn from documents (doc_id, text) and labels (doc_id, label 0/1), at most ``max_examples`` of them, each whole.

    One task gets the sample and trains; the driver gets the few kilobytes of the network.
    """
    ids = (labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # max_examples small rows

    def train(rows: pa.Table) -> pa.Table:
        let_go()
        rows = rows.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        labels, net = rows.column("label").to_numpy().astype(float), ByteNet()
        if 0 < labels.sum() < len(labels):
            parts = [chunks_of(*text_bytes(piece.column("text"))) for batch in rows.to_batches() for piece in pieces_of(batch)]
            count = np.concatenate([np.diff(first) for _, first in parts])
            net.fit(np.concatenate([chunks for chunks, _ in parts]), np.concatenate([[0], np.cumsum(count)]), labels, steps)
        else:
            net.constant = float(labels.mean())
        return pa.table({"net": pa.array([pickle.dumps(net)], pa.binary())})

    ship(docs.sparkSession)
    fitted = sample.groupBy().applyInArrow(train, "net binary").first()  # max_examples rows in one group
    if fitted:
        return pickle.loads(bytes(fitted["net"]))
    net = ByteNet()
    net.constant = 0.5
    return net


def score_quality(docs: DataFrame, net: ByteNet, into: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1. One pass, no shuffle; the network is a few kilobytes."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    names = [*docs.columns, into]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, most=PIECE_BYTES // 4):
                score = sent.value.probability(*chunks_of(*text_bytes(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score, pa.float64())], names)

    return map_arrow(docs, judge, T.StructType([*docs.schema, T.StructField(into, T.DoubleType())]))
