"""Near-duplicate vectors by an exact subspace pigeonhole join.

Vectors of length one with cosine >= t have a squared distance of at most D = 2 - 2t. A random rotation
spreads a vector evenly over ``blocks`` low-dimensional subspaces, each with a share of the budget
proportional to its dimensions. If a pair is within D, then it is within the budget of at least one block
(else the parts would add up to more). So each block is range-joined on its own: its first coordinate is
cut into cells twice as wide as the block's radius, a vector also visits the one neighbouring cell that its radius
reaches, and cells are compared in numpy. A candidate pair is taken up only in its first block within
budget and in the home cell of its smaller class, so the union needs no removal of repeats, and it is verified
by the cosine of the vectors as they were given, in double precision: dot product over the product of the lengths. The rotated
vectors only choose candidates; they are kept in single precision, and every budget and cell is wider than its rounding.

Pairs are never written out: a cell gives each vector's number of partners and a spanning forest of its
links. Equal vectors of a label are one class from the start. A label of many classes is cut into chunks by
ranges of its classes' hashes, and the chunks of a cell meet pairwise: a group is a cell with the chunk of the
smaller class and the chunk of its partner, so it holds at most two chunks of about ``CHUNK`` classes, however
large the label or the cell is.

Defined results: rows link only if their labels are equal and not null. Vectors that are null, zero or
hold null or non-finite components link with nothing, nor do rows without vec_id; vectors of different
lengths never link. Rows of one vec_id link by their own vectors. Repeated rows are kept and count as
other vectors. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import arrow_type, connected_components, map_arrow, spool

#: Subspaces, and classes in a chunk of a label; a group compares two chunks with one another.
BLOCKS, CHUNK = 4, 20_000
#: Rows and columns of the distances that a group has in memory at a time.
_TILE, _PARTNERS = 512, 4096
#: What rounding may add to a squared distance: of the stored rotated vectors, and of a product in single precision.
_SLACK, _PRODUCT_SLACK = 1e-6, 2e-5


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, blocks: int) -> np.ndarray:
    return np.unique(np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int))


def budgets(dims: int, blocks: int, similarity: float) -> np.ndarray:
    """Squared distance that a block may use: the whole budget by share of dimensions."""
    return (2 - 2 * similarity) * np.diff(block_edges(dims, blocks)) / dims


def given(x: np.ndarray, narrow: bool) -> np.ndarray:
    """Vectors in the precision that they came in; those of double precision by a power of two near their largest component.

    The power changes no cosine and keeps lengths finite.
    """
    return x.astype(np.float32) if narrow else np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _visits(similarity: float, blocks: int, narrow: bool, shape: pa.Schema):
    """Each class at its home cell, its neighbouring cell, and the pairs of chunks it belongs to."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                vectors = [np.array(v, float) for v in part.column("embedding").to_pylist()]
                by_dims: dict[int, list[int]] = {}
                for i, v in enumerate(vectors):
                    by_dims.setdefault(len(v), []).append(i)
                for dims, rows in by_dims.items():
                    raw = np.array([vectors[i] for i in rows])
                    x = given(raw, False)
                    x = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dims)).astype(np.float32)
                    yield from _cells(x, given(raw, narrow), [part.take(pa.array(rows)).column(c) for c in ("cls", "label", "copies", "chunks")], dims)

    def _cells(x, raw, columns, dims):
        cls, label, copies, chunks = (c.to_numpy(zero_copy_only=False) for c in columns)
        edges, radius = block_edges(dims, blocks), np.sqrt(budgets(dims, blocks, similarity) + 4 * _SLACK)
        packed, whole = (pa.array([r.tobytes() for r in v], pa.binary()) for v in (x, raw))
        # ranges of the hash, in the order of the classes: the chunk of a smaller class is never the later one
        own = ((cls.view(np.uint64) + np.uint64(1 << 63) >> np.uint64(32)) * chunks.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        for b, first in enumerate(edges[:-1]):
            place = x[:, first].astype(float) / (2 * radius[b])
            cell = np.floor(place).astype(np.int64)
            aside = cell + np.where(place - cell < 0.5, -1, 1)
            for c in range(chunks.max()):
                # at home it meets the chunks from its own on as the smaller class, and those before as the partner; aside it is the partner only
                for to, rows in ((cell, np.flatnonzero(c < chunks)), (aside, np.flatnonzero(c <= own))):
                    home = (own[rows] <= c) if to is cell else np.zeros(len(rows), bool)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(label[rows], pa.int64()), pa.array(np.full(len(rows), dims, np.int32)), pa.array(np.full(len(rows), b, np.int32)),
                        pa.array(to[rows]), pa.array(np.minimum(own[rows], c), pa.int32()), pa.array(np.maximum(own[rows], c), pa.int32()),
                        pa.array(home), pa.array(cls[rows]), pa.array(copies[rows]), packed.take(pa.array(rows)), whole.take(pa.array(rows))], schema=shape)

    return visit


def _compare(similarity: float, blocks: int, narrow: bool):
    """Partners of each class of a cell, and the root of each in the cell's spanning forest."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        dims, block = key[1].as_py(), key[2].as_py()
        edges, budget = block_edges(dims, blocks), budgets(dims, blocks, similarity)
        cls, copies = rows.column("cls").to_numpy(), rows.column("copies").to_numpy()
        home = rows.column("home").to_numpy(zero_copy_only=False)
        # inside one chunk all are partners, else only the rows of the later chunk
        partners = np.arange(len(cls)) if key[4].as_py() == key[5].as_py() else np.flatnonzero(~home)
        home = np.flatnonzero(home)
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32).reshape(-1, dims)
        raw = np.frombuffer(b"".join(rows.column("given").to_pylist()), np.float32 if narrow else float).reshape(-1, dims)
        part = x[:, edges[block]:edges[block + 1]]
        square = (part * part).sum(axis=1)
        links, root = np.zeros(len(cls), np.int64), np.arange(len(cls))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for at, to in product(range(0, len(home), _TILE), range(0, len(partners), _PARTNERS)):
            mine, other = home[at:at + _TILE], partners[to:to + _PARTNERS]
            near = square[mine][:, None] + square[other][None] - 2 * part[mine] @ part[other].T <= budget[block] + _PRODUCT_SLACK
            near &= cls[mine][:, None] < cls[other][None]
            i, j = np.nonzero(near)
            i, j = mine[i], other[j]
            for s in range(0, len(i), 100_000):
                a, b = i[s:s + 100_000], j[s:s + 100_000]
                apart = x[a].astype(float) - x[b]
                used = np.add.reduceat(apart * apart, edges[:-1], axis=1) <= budget + _SLACK
                first = np.flatnonzero((used.argmax(axis=1) == block) & used[:, block])
                linked = first[cosines(raw[a[first]], raw[b[first]]) >= similarity]
                a, b = a[linked], b[linked]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for p, q in zip(a, b):
                    p, q = find(p), find(q)
                    if p != q:
                        root[max(p, q)] = min(p, q)
        some = np.flatnonzero(links)
        return pa.table({"cls": cls[some], "links": links[some], "root": cls[np.array([find(i) for i in some], np.int64)]})

    return compare


def near_duplicate_vectors(vectors: DataFrame, similarity: float = 0.93, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.col("label").cast("long").alias("label"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
                        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # equal vectors: by a 64-bit hash of the label and the components, with -0 read as 0
    rows = rows.withColumn("cls", F.when(usable, F.xxhash64("label", F.transform("embedding", lambda v: v + 0.0))))
    found = rows.where("cls is not null")
    classes = spool(found.groupBy("cls").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"),
                                             F.min_by("embedding", "vec_id").alias("embedding")), "vector-classes")
    chunks = classes.groupBy("label").agg((1 + F.floor(F.count("*") / F.lit(CHUNK))).alias("chunks"))
    shape = "label long, dims int, block int, cell long, chunk int, partner int, home boolean, cls long, copies long, vector binary, given binary"
    narrow = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    cells = map_arrow(classes.join(chunks, "label").select("cls", "label", "copies", "embedding", "chunks"),
                      _visits(similarity, blocks, narrow, arrow_type(shape)), shape)
    linked = spool(cells.groupBy("label", "dims", "block", "cell", "chunk", "partner")
                   .applyInArrow(_compare(similarity, blocks, narrow), "cls long, links long, root long"), "vector-links")
    comps = connected_components(linked.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "vector-components")
    total = classes.select("cls", "first", "copies").join(linked.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left")
    total = total.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = total.groupBy("comp").agg(F.min("first").alias("component_id"))
    total = total.join(smallest, "comp").select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cls").join(total, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
