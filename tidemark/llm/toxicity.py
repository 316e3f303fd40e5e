"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vector of a text has all its words that occur in an example, by TF-IDF, and every text is searched.
Words and stems that tell toxic examples (by a likelihood ratio) have a component more of up to ``BOOST`` times
their TF-IDF: by plain TF-IDF a few toxic words would be lost among the many others of a text.

Defined results: texts without a word of an example have cosine 0 with all; they get the rate of toxic examples
among examples without a word. Without labels of both kinds every score is the share of toxic
labels, 0.5 without any, and an empty table gives no rows. Texts of any length are read whole, a few at a time. Examples with equal vectors count as one neighbour with the votes of all;
equal cosines go to the smaller example number. Repeated rows get equal scores. Other columns are kept.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.common import arrow_type, held, let_go, map_arrow, pieces_of, spool

#: Bound of the fit: labelled rows, which bound the index that the tasks load.
MAX_EXAMPLES = 12_000
#: Bytes of a piece of the stored index.
PIECE = 1 << 24
#: Terms in at least this many examples are tested against the label by their likelihood ratio; those boosted
#: would hold this many that have nothing to do with it. They are toxic this many times as often as all.
MIN_EXAMPLES, CHANCE_TERMS, LEAST_LIFT = 4, 0.5, 2.0
NEIGHBOURS, BLOCK, STEMS = 15, 256, (4, 7)
#: Weight over that of a word of the term that tells most; others get less by the root of their likelihood ratio.
BOOST = 5.0
#: Texts searched at a time; terms in more than one of so many examples are held densely; error allowed in single precision.
_TOGETHER, _RARE, _SLACK = 64, 16, 1e-5
#: Examples of a label whose shingles of so many words have this Jaccard similarity are copies.
SHINGLE, COPY = 5, 0.75
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 300_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(word: str) -> list[str]:
    """The word and its stems, since an ending may hide a word."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


class BlockMaxIndex:
    """Exact top examples by postings of rare terms, and blocks of examples by the largest weight of each frequent term.

    Postings give the cosine over the rare terms. A block's bound adds the largest that its frequent terms can,
    and only blocks whose bound reaches a text's k-th best are looked up for it. The best are weighed again in double precision.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int32)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)]).astype(float)
        self._fill(term, weight, np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64), n_terms, block)

    @classmethod
    def of(cls, term: np.ndarray, weight: np.ndarray, first: np.ndarray, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """From the vectors one after another, which are kept as they are; first: where each begins, with the end."""
        index = cls.__new__(cls)
        index._fill(term, weight, first, n_terms, block)
        return index

    def _fill(self, term: np.ndarray, weight: np.ndarray, first: np.ndarray, n_terms: int, block: int) -> None:
        self.block, self.size, self.n_terms, self.first = block, len(first) - 1, n_terms, first
        example = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(first))
        if ((term[1:] < term[:-1]) & (example[1:] == example[:-1])).any():  # the terms of an example lie in order
            order = np.lexsort((term, example))
            term, weight = term[order], weight[order]
        self.term, self.weight = term, weight
        seen = np.bincount(term, minlength=n_terms)
        frequent = np.flatnonzero(seen > max(1, self.size // _RARE))
        self.place = np.full(n_terms, -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        often = self.place[term] >= 0
        self.dense = np.zeros((len(frequent), self.size), np.float32)
        self.dense[self.place[term[often]], example[often]] = weight[often]
        blocks = np.arange(0, self.size, block)
        self.max = np.maximum.reduceat(self.dense, blocks, axis=1) if self.size else np.zeros((len(frequent), 0), np.float32)
        self.blocks = blocks
        rare = ~often
        order = np.argsort(term[rare], kind="stable")
        order = order.astype(np.int32 if len(order) < 2**31 else np.int64)
        self.example = example[rare][order]
        del example, often
        self.part = weight.astype(np.float32)[rare][order]
        self.start = np.concatenate([[0], np.cumsum(np.where(self.place < 0, seen, 0))]).astype(np.int64)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k examples of highest positive cosine, as (-cosine, example) in order."""
        return self.tops([(terms, weights)], k)[0]

    def tops(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        if not self.size:
            return [[] for _ in vectors]
        score = np.zeros((len(vectors), self.size), np.float32)
        often = np.zeros((len(vectors), len(self.dense)), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            at = self.place[terms]
            often[i, at[at >= 0]] = weights[at >= 0]
            start, many = self.start[terms], self.start[terms + 1] - self.start[terms]
            posting = np.arange(many.sum()) + np.repeat(start - np.cumsum(many) + many, many)
            score[i] = np.bincount(self.example[posting], self.part[posting] * np.repeat(weights, many), self.size)
        bound = np.maximum.reduceat(score, self.blocks, axis=1) + often @ self.max
        kth = max(self.size - k, 0)
        # the blocks of the highest bounds first, which raise the least cosine; then the others that still reach it
        early = bound >= np.partition(bound, -min(2, bound.shape[1]), axis=1)[:, [-min(2, bound.shape[1])]]
        self._add(score, often, early)
        least = np.partition(score, kth, axis=1)[:, kth]  # some are yet without their frequent terms: it can only rise
        self._add(score, often, ~early & (bound >= least[:, None] - _SLACK))
        return [self._best(*v, row, k) for v, row in zip(vectors, score)]

    def _add(self, score: np.ndarray, often: np.ndarray, wanted: np.ndarray) -> None:
        """The frequent terms' part of the wanted blocks."""
        for b, first in enumerate(self.blocks):
            rows = np.flatnonzero(wanted[:, b])
            if len(rows):
                score[rows, first:first + self.block] += often[rows] @ self.dense[:, first:first + self.block]

    def _best(self, terms: np.ndarray, weights: np.ndarray, score: np.ndarray, k: int) -> list[tuple[float, int]]:
        kth = max(self.size - k, 0)
        at = np.flatnonzero((score >= np.partition(score, kth)[kth] - _SLACK) & (score > 0))
        if not len(at):
            return []
        order = np.argsort(terms, kind="stable")
        terms, weights = terms[order].astype(np.int32), weights[order]
        cosine = np.zeros(len(at))
        for i, (first, end) in enumerate(zip(self.first[at], self.first[at + 1])):
            # a text's terms are looked up in the example's, which may be many more
            place = first + np.minimum(np.searchsorted(self.term[first:end], terms), end - first - 1)
            both = self.term[place] == terms
            cosine[i] = np.cumsum(weights[both] * self.weight[place[both]])[-1] if both.any() else 0.0
        order = np.lexsort((at, -cosine))[:k]
        return [(-float(min(cosine[i], 1.0)), int(at[i])) for i in order]


class _Examples:
    """Rows of an Arrow table as (doc_id, label, count of each word), made one at a time to spare the driver's memory."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    def __len__(self) -> int:
        return self.rows.num_rows

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, int]]]:
        for doc, label, words, counts in zip(*self.rows.columns):
            yield doc.as_py(), label.as_py(), dict(zip(words.as_py(), counts.as_py()))


class ToxicityModel:
    """Words with their inverse document frequency, telling terms, the index of examples and their votes."""

    def __init__(self, telling: dict[str, float], examples: Collection[tuple[int, int, dict[str, int]]], prior: float, neighbours: int = NEIGHBOURS):
        """telling: weights of words and stems over ``BOOST``; examples: (doc_id, label, count of each word)."""
        self.k = neighbours
        seen = Counter(w for _, _, words in examples for w in words)
        self.terms = {w: i for i, w in enumerate(sorted(seen))}
        self.telling = {t: len(self.terms) + i for i, t in enumerate(telling)}
        self.idf = np.array([math.log((1 + len(examples)) / (1 + seen[w])) + 1e-6 for w in self.terms] + [BOOST * v for v in telling.values()])
        self._starts = {t.rstrip("*")[:4] for t in telling}
        groups: dict[tuple, list] = {}
        for doc, label, words in examples:
            ids, counts = self.features(words)
            g = groups.setdefault((ids.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()), [doc, 0, 0])
            g[0], g[1], g[2] = min(g[0], doc), g[1] + label, g[2] + 1
        _, pos, n = groups.pop((b"", b""), [0, 0, 0])
        self.none = (pos + prior) / (n + 1)
        vectors = [(np.frombuffer(i, np.int32), np.frombuffer(c, np.int32), g) for (i, c), g in groups.items()]
        del groups
        # examples led by the same term share blocks, so that more blocks are ruled out by their bound
        vectors.sort(key=lambda x: (int(x[0][np.argmax(self.vector(x[0], x[1])[1])]), x[2][0]))
        self.doc = np.array([g[0] for *_, g in vectors], np.int64)
        self.pos = np.array([g[1] for *_, g in vectors], float)
        self.n = np.array([g[2] for *_, g in vectors], float)
        self.ids, self.counts = (np.concatenate([v[side] for v in vectors] or [np.zeros(0, np.int32)]) for side in (0, 1))
        self.first = np.concatenate([[0], np.cumsum([len(i) for i, *_ in vectors])]).astype(np.int64)

    @cached_property
    def index(self) -> BlockMaxIndex:
        """Made where texts are judged: the task that learns the model, and what it sends, have no need of it."""
        return self._indexed(self._weights())

    def _weights(self) -> np.ndarray:
        weight = np.empty(len(self.ids))
        for a, b in zip(self.first[:-1], self.first[1:]):
            weight[a:b] = self.vector(self.ids[a:b], self.counts[a:b])[1]
        return weight

    def _indexed(self, weight: np.ndarray) -> BlockMaxIndex:
        return BlockMaxIndex.of(self.ids, weight, self.first, len(self.idf))

    def __getstate__(self) -> dict:
        """Terms and counts of the examples; the index is made from them where the model is loaded."""
        own = {k: v for k, v in self.__dict__.items() if k not in ("index", "terms")}
        return own | {"words": "\n".join(self.terms)}

    def __setstate__(self, state: dict) -> None:
        words = state.pop("words")
        self.__dict__.update(state)
        self.terms = {w: i for i, w in enumerate(words.split("\n") if words else [])}

    def features(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of the terms of a text, in order."""
        terms, starts, telling = self.terms.get, self._starts, self.telling
        ids, counts, told = [], [], {}
        for word, n in words.items():
            if (at := terms(word)) is not None:  # words are distinct, and so are their numbers
                ids.append(at)
                counts.append(n)
            if word[:4] in starts:
                for term in terms_of(word):
                    if (at := telling.get(term)) is not None:
                        told[at] = told.get(at, 0) + n
        ids, counts = np.array([*ids, *told], np.int64), np.array([*counts, *told.values()], np.int64)
        order = np.argsort(ids)
        return ids[order], counts[order]

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the terms, at length one."""
        w = counts * self.idf[ids]
        return ids, w / math.sqrt(float(w @ w))

    def judge(self, texts: list[str | None]) -> Iterator[tuple[float, float, list[int]]]:
        """Score, best cosine, and the examples that speak for it, for each text."""
        for at in range(0, len(texts), _TOGETHER):
            found = [self.features(Counter(words_of(t))) for t in texts[at:at + _TOGETHER]]
            tops = iter(self.index.tops([self.vector(*f) for f in found if len(f[0])], self.k))
            for f in found:
                best = next(tops) if len(f[0]) else []
                if not best:
                    yield self.none, 0.0, []
                    continue
                at_ = np.array([i for _, i in best], np.int64)
                vote = np.array([1 / (1.02 + c) - 1 / 1.02 for c, _ in best])  # by distance, none at cosine 0: the cosine is -c
                score = (float(vote @ self.pos[at_]) + self.none) / (float(vote @ self.n[at_]) + 1)
                yield score, -best[0][0], self.doc[at_[:3]].tolist()


def _sketch(text: str | None) -> int:
    """Three smallest word hashes in one number: near copies mostly share it, and so may others."""
    low = [2**32] * 3
    for word in set(words_of(text)):
        data = word.encode()
        for i, seed in enumerate((1, 2, 3)):
            low[i] = min(low[i], zlib.crc32(data, seed * 0x9E3779B1 & 0xFFFFFFFF))
    return zlib.crc32(repr(low).encode()) | zlib.crc32(repr(low[::-1]).encode()) << 31


def _shingles(text: str | None) -> set[tuple[str, ...]]:
    tokens = (text or "").split()
    return {tuple(tokens[i:i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))}


def copies(one: str | None, other: str | None) -> bool:
    """Whether two texts are equal or near copies by their shingles."""
    if one == other:
        return True
    a, b = _shingles(one), _shingles(other)
    return len(a & b) >= COPY * len(a | b)


def _sample(docs: DataFrame, labelled: DataFrame, max_examples: int) -> DataFrame:
    """Texts of a bounded sample of labelled documents, chosen by hash; copies that fell into it count once.

    Else each word of a text with many copies would seem to go with its label. Equal texts of a label are one;
    a text that shares its sketch with the first of its label is left out only if their shingles say so too.
    """
    ids = (labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # max_examples rows
    drawn = drawn.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "label")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces_of(batch)):
            keys = pa.array([_sketch(t) for t in piece.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*piece.columns, keys], [*piece.schema.names, "sketch"])

    drawn = spool(map_arrow(drawn, sketches, T.StructType([*drawn.schema, T.StructField("sketch", T.LongType())])), "examples")
    first = drawn.groupBy("sketch", "label").agg(F.min(F.struct("doc_id", "text")).alias("first"), F.count("*").alias("n")).where("n > 1")
    pairs = drawn.join(first.select("sketch", "label", F.col("first.doc_id").alias("first"), F.col("first.text").alias("like")),
                       ["sketch", "label"], "left").select("doc_id", "text", "label", "first", "like")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text, first, like = (batch.column(c).to_pylist() for c in ("doc_id", "text", "first", "like"))
            own = [f is None or (d, t) == (f, o) or not copies(t, o) for d, t, f, o in zip(doc, text, first, like)]
            yield pa.RecordBatch.from_arrays(batch.columns[:3], batch.schema.names[:3]).filter(pa.array(own, pa.bool_()))

    return spool(map_arrow(pairs, verified, T.StructType(drawn.schema.fields[:3])), "distinct-examples")


class FittedToxicity(NamedTuple):
    """A model as it is sent to the tasks: its packed bytes, the weights of its telling terms, and whether it knows any term."""
    data: bytes
    telling: dict[str, float]
    terms: bool


def _packed(model: ToxicityModel) -> bytes:
    return zlib.compress(pickle.dumps(model), 3)


def _stored(model: ToxicityModel) -> FittedToxicity:
    return FittedToxicity(_packed(model), dict.fromkeys(model.telling, 0.0), bool(model.terms))


def fit_toxicity(docs: DataFrame, labelled: DataFrame, max_examples: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS) -> FittedToxicity:
    """Learn from documents (doc_id, text) and labels (doc_id, label 0/1), at most ``max_examples`` of them.

    The index is built by one task from the sample, whose rows are bounded; the driver only passes its bytes on.
    """
    sample = _sample(docs, labelled, max_examples)
    n, pos = sample.agg(F.count("*"), F.sum("label")).first()
    pos = pos or 0
    prior = pos / n if n else 0.5
    if not 0 < pos < n:
        return _stored(ToxicityModel({}, [], prior, neighbours))
    counted = map_arrow(sample, _term_counts, "term string, pos long, n long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= MIN_EXAMPLES)
    counted = spool(counted, "terms")
    tested = counted.count()

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    # twice the logarithm of the likelihood ratio of "the term has its own share of toxic examples"
    with_, toxic = F.col("n").cast("double"), F.col("pos").cast("double")
    ratio = 2 * (part(toxic, with_ * prior) + part(with_ - toxic, with_ * (1 - prior))
                 + part(pos - toxic, (n - with_) * prior) + part((n - pos) - (with_ - toxic), (n - with_) * (1 - prior)))
    kept = (counted.withColumn("ratio", ratio).where((F.col("ratio") >= 2 * math.log(max(tested, 1) / CHANCE_TERMS)) & (toxic >= LEAST_LIFT * prior * with_))
            .orderBy(F.desc("ratio"), "term").collect())  # terms of the sample that tell more than chance
    # a term that may tell by chance only gets less than the one that tells most
    telling = {r["term"]: (math.log((1 + n) / (1 + r["n"])) + 1e-6) * math.sqrt(r["ratio"] / kept[0]["ratio"]) for r in kept}

    shape = "doc_id long, label int, words array<string>, counts array<int>"
    out = arrow_type(shape)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                found = [Counter(words_of(t)) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), piece.column("label").cast(pa.int32()),
                                                  pa.array([list(f) for f in found], out.field(2).type),
                                                  pa.array([list(f.values()) for f in found], out.field(3).type)], schema=out)

    def build(rows: pa.Table) -> pa.Table:
        let_go()
        model = ToxicityModel(telling, _Examples(rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])), prior, neighbours)
        data = _packed(model)
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        return pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "data": pa.array(pieces, pa.binary())})

    built = map_arrow(sample, words, shape).groupBy().applyInArrow(build, "piece int, data binary")  # max_examples rows
    pieces = spool(built, "toxicity-index").orderBy("piece").toLocalIterator()
    return FittedToxicity(b"".join(bytes(r["data"]) for r in pieces), telling, True)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples with a term, by label, for the rows of a task."""
    pos, n = Counter(), Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([pos[t] for t in n], pa.int64()),
                                           pa.array(list(n.values()), pa.int64())], ["term", "pos", "n"])

    for piece in (p for batch in batches for p in pieces_of(batch)):
        for text, label in zip(piece.column("text").to_pylist(), piece.column("label").to_pylist()):
            found = {t for w in set(words_of(text)) for t in terms_of(w)}
            n.update(found)
            if label:
                pos.update(found)
            if len(n) > _FLUSH:
                yield rows()
                pos, n = Counter(), Counter()
    yield rows()


def _loaded(data: bytes) -> ToxicityModel:
    def load() -> ToxicityModel:
        model = pickle.loads(zlib.decompress(data))
        weight = model._weights()
        del model.counts  # ahead of the index, which takes most
        model.index = model._indexed(weight)
        return model

    return held(("toxicity", zlib.crc32(data)), load)


def score_toxicity(docs: DataFrame, model: FittedToxicity, into: tuple[str, str, str] = ("score", "top_cosine", "evidence")) -> DataFrame:
    """The documents with three more columns: a score from 0 to 1, the best cosine, and the nearest examples' doc_ids.

    One pass without a shuffle; the model has a bounded size and is sent to the executors once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.data)
    names = [*docs.columns, *into]
    schema = T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in zip(into, (T.DoubleType(), T.DoubleType(), T.ArrayType(T.LongType()))))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(sent.value)
        for batch in batches:
            for piece in pieces_of(batch):
                found = list(model.judge(piece.column("text").to_pylist()))
                extra = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()),
                         pa.array([f[2] for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *extra], names)

    return map_arrow(docs, judge, schema, holds=True)
