import random
from collections import Counter, defaultdict

import pytest

from llm_helpers import awkward, frame, prose, rows_of, words
from tidemark.llm.mixing import mix, mixed_documents


def level_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Pour the words out by weight; full sources drop out and the rest is poured again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def documents(seed):
    rng = random.Random(seed)
    rows = awkward(rng)
    for i in range(200, 500):
        rows.append((i, prose(rng, rng.randrange(0, 120)), "en", rng.choice(["a", "a", "a", "b", "c", "é", "zz", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words(spark, seed):
    rows = documents(seed)
    out = mix(frame(spark, rows)).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(words(text))
    want, taken = level_targets(dict(sizes)), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
    assert all(want[s] - 1 < taken[s] <= want[s] + 1e-6 for s in sizes)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1, len(words(t))) for i, t, *_ in rows)


def test_reruns_and_partitions_agree(spark):
    docs = frame(spark, documents(3))
    first = rows_of(mix(docs), "doc_id", "size", "taken")
    assert first == rows_of(mix(docs.repartition(7)), "doc_id", "size", "taken")
    assert first != rows_of(mix(docs, seed=12), "doc_id", "size", "taken")


def test_good_documents_are_drawn_more_often(spark):
    rows = [(i, ("plain words here " if i % 2 else "1$ %%% &&&9 ") * 10, "en", "a") for i in range(600)]
    out = mix(frame(spark, rows), share=0.3).collect()
    good, poor = (sum(r.taken for r in out if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 4 * poor


def test_documents_of_the_mix(spark):
    rows = [(i, prose(random.Random(i), 20 + i % 50), "en", "ab"[i % 3 == 0]) for i in range(200)]
    docs = frame(spark, rows)
    plan = {r.doc_id: r.taken for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = Counter()
    texts = dict((r[0], r[1]) for r in rows)
    for r in out.collect():
        taken[r.doc_id] += len(words(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) and words(r.text) == words(texts[r.doc_id])[:len(words(r.text))]
    assert dict(taken) == {i: n for i, n in plan.items() if n}


def test_empty_table(spark):
    assert mix(frame(spark, [])).collect() == [] and mixed_documents(frame(spark, [])).collect() == []
    assert rows_of(mix(frame(spark, [(1, None, None, None), (2, "", "x", "a")])), "size", "target", "taken") == [(0, 0.0, 0)] * 2


def test_awkward_rows_in_the_mix(spark):
    docs = frame(spark, awkward(random.Random(9)))
    assert {r.doc_id for r in mixed_documents(docs).collect()} <= {r.doc_id for r in docs.collect()}


def test_rows_that_share_a_doc_id_have_their_own_decisions(spark):
    """Sources of rows without doc_id, or of one doc_id, meet their targets in the mixed documents as others do."""
    from tidemark.llm.mixing import mix, mixed_documents
    rng = random.Random(21)
    rows = [(rng.choice([None, 5]), prose(rng, rng.randrange(5, 40)), "en", s) for s in "ab" for _ in range(120)]
    docs = frame(spark, rows)
    targets = {r.source: r.target for r in mix(docs).select("source", "target").distinct().collect()}
    got = {}
    for r in mixed_documents(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
    assert got.keys() == targets.keys() and all(abs(got[s] - targets[s]) <= 1 for s in got)


def test_the_edge_cell_is_narrow_whatever_the_quality(spark):
    """A source of digits and signs, whose keys are all large, does not put most of its documents into one cell."""
    from pyspark.sql import functions as F
    from tidemark.llm import mixing as M
    for quality in (M.LEAST_WEIGHT, 0.3, 1.0):
        keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").alias("tie")).withColumn("k", M.sampling_key(11, F.lit(quality)))
        spread = 2 - F.exp(-F.col("k")) - F.exp(-F.col("k") * M.LEAST_WEIGHT)
        cell = F.least(F.floor(F.lit(M.KEY_CELLS / 2) * spread), F.lit(M.KEY_CELLS - 1))
        assert keys.groupBy(cell).count().agg(F.max("count")).first()[0] < 20_000 * 0.005
