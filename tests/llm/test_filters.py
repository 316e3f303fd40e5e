import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import awkward, frame, prose
from tidemark.llm.quality import ByteNet, chunks_of, fit_quality, recurs, score_quality
from tidemark.llm import toxicity
from tidemark.llm.toxicity import BlockMaxIndex, ToxicityModel, _sample, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.1"
has_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, label int")


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(400):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        w = rng.random(len(terms))
        vectors.append((terms, w / np.linalg.norm(w)))
    dense = np.zeros((400, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(vectors, 40, block=16)
    for t, w in vectors[:60]:
        cosine = dense[:, t] @ w
        order = sorted(((-c, i) for i, c in enumerate(cosine) if c > 0))[:7]
        got = index.top(t, w, 7)
        assert [i for _, i in got] == [i for _, i in order] or np.allclose([c for c, _ in got], [c for c, _ in order])
        assert np.allclose([c for c, _ in got], [c for c, _ in order])


def test_toxicity_of_awkward_rows(spark):
    rng = random.Random(4)
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are no part of a word: all words would be "w", all texts copies
    rows = [(i, prose(rng, 40).translate(letters) + (" vilewords nastythings" if i % 4 == 0 else ""), "en", "a") for i in range(100, 300)]
    docs = frame(spark, rows + awkward(rng) + [(900, "calm VILEWORDSX text", "en", "a")])
    model = fit_toxicity(docs, labelled(spark, [(i, int(i % 4 == 0)) for i in range(100, 280)] + [(None, 1), (5, None)]))
    scored = score_toxicity(docs, model, ("_s", "_c", "_e"))
    assert scored.columns == [*docs.columns, "_s", "_c", "_e"] and scored.count() == docs.count()
    got = {r.doc_id: r for r in scored.where("doc_id is not null").collect()}
    assert all((got[i]._s >= 0.3) == (i % 4 == 0) for i in range(100, 300))
    assert got[900]._s >= 0.3 and got[900]._e[0] in range(100, 280, 4)  # an unseen ending; the nearest example is a toxic one
    assert got[1]._s == got[2]._s == got[4]._s < 0.3 and got[1]._c == 0 and got[1]._e == []


def test_toxicity_of_words_with_digits(spark):
    """Texts that differ in digits only are no copies of one another."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + (" vilewords nastythings" if i % 4 == 0 else ""), "en", "a") for i in range(100, 300)]
    docs = frame(spark, rows + awkward(rng) + [(900, "calm VILEWORDSX text", "en", "a")])
    labels = labelled(spark, [(i, int(i % 4 == 0)) for i in range(100, 280)] + [(None, 1), (5, None)])
    assert _sample(docs, labels, 1000).count() == 180
    got = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels), ("_s", "_c", "_e")).where("doc_id is not null").collect()}
    assert all((got[i]._s >= 0.3) == (i % 4 == 0) for i in range(100, 300))
    assert got[900]._s >= 0.3 and set(got[900]._e) <= set(range(100, 280, 4))  # an unseen ending


def test_every_text_is_searched_by_all_its_words(spark):
    """Toxic examples in rare words, which no test of terms could keep, are found by themselves and by a copy."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    common = [word() for _ in range(300)]
    rows = [(i, " ".join(rng.choices(common, k=40)), "en", "a") for i in range(100, 200)]
    rows += [(i, " ".join(word() for _ in range(40)), "en", "a") for i in range(200, 210)]
    docs = frame(spark, rows + [(i + 800, t, *more) for i, t, *more in rows] + [(5000, "unheard", "en", "a")])
    model = fit_toxicity(docs, labelled(spark, [(i, int(i >= 200)) for i in range(100, 210)]))
    assert not model.telling
    got = {r.doc_id: r for r in score_toxicity(docs, model, ("_s", "_c", "_e")).collect()}
    for i in range(100, 210):
        for own in (got[i], got[i + 800]):
            assert own._e[0] == i and own._c == pytest.approx(1) and (own._s >= 0.3) == (i >= 200)
    assert got[5000]._c == 0 and got[5000]._e == []


def test_search_is_exact_with_rare_and_frequent_terms():
    rng = np.random.default_rng(2)
    def some():
        terms = np.unique(np.minimum(rng.zipf(1.3, 40), 500) - 1)
        w = rng.random(len(terms))
        return terms, w / np.linalg.norm(w)

    vectors = [some() for _ in range(300)]
    dense = np.zeros((300, 500))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = BlockMaxIndex(vectors, 500, block=16)
    texts = vectors[:30] + [some() for _ in range(30)]
    assert 0 < len(index.dense) < 500
    for (t, w), got in zip(texts, index.tops(texts, 5)):
        cosine = dense[:, t] @ w
        assert [i for _, i in got] == list(np.lexsort((np.arange(300), -cosine.round(12)))[:5])


def test_only_copies_leave_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_sketch", lambda text: 0)  # all share a sketch
    rng = random.Random(5)
    base = prose(rng, 60).split()
    texts = [" ".join(base), " ".join(base), " ".join(base[:59] + ["end"]), " ".join(base[:30] + ["cut"] + base[31:]), *(prose(rng, 60) for _ in range(20)),
             "1 2", "3 4", None, None]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = [r.doc_id for r in _sample(docs, labelled(spark, [(i, 0) for i in range(len(texts))]), 1000).collect()]
    assert sorted(kept) == [0, *range(4, 27)]


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(8, 1), (9, 1)], 1.0), ([(8, 0)], 0.0)])
def test_without_labels_of_both_kinds(spark, labels, want):
    docs = frame(spark, awkward(random.Random(4)))
    net = fit_quality(docs, labelled(spark, labels))
    model = fit_toxicity(docs, labelled(spark, labels))
    assert {r.q for r in score_quality(docs, net, "q").collect()} == {want}
    assert all(abs(r.t - want) < 1e-9 for r in score_toxicity(docs, model, ("t", "c", "e")).collect())


def test_filters_of_an_empty_table(spark):
    docs = frame(spark, [])
    assert score_toxicity(docs, fit_toxicity(docs, labelled(spark, [])), ("t", "c", "e")).collect() == []
    assert score_quality(docs, fit_quality(docs, labelled(spark, [(1, 1)])), "q").collect() == []


def test_chunks_cover_the_whole_text():
    text = bytes(np.random.default_rng(0).integers(1, 255, 3000, dtype=np.uint8))
    rows = np.array([0, 0, 3, 3000])
    chunks, first = chunks_of(np.frombuffer(text, np.uint8), rows)
    assert list(np.diff(first)) == [1, 1, 7] and (chunks[0] == 256).all()
    own, rebuilt = chunks[first[2]:], text[3:]
    assert bytes(b for k, c in enumerate(own) for b in (c if k == 0 else c[64:]) if b < 256) == rebuilt


def test_recurs_marks_what_came_before():
    chunk = np.full((1, 512), 256, np.int16)
    chunk[0, :40] = np.frombuffer(b"abcdefghij" * 4, np.uint8)
    assert list(np.flatnonzero(recurs(chunk)[0])[:3]) == [10, 11, 12] and recurs(chunk)[0][:10].sum() == 0


def test_network_gradient():
    net = ByteNet(3)
    rng = np.random.default_rng(3)
    chunks = rng.integers(97, 123, (12, 512)).astype(np.int16)
    before = net.probability(chunks, np.arange(13))
    labels = np.arange(12) % 2
    chunks[labels == 1, ::7] = ord("!")
    net.fit(chunks, np.arange(13), labels.astype(float), steps=60)
    after = net.probability(chunks, np.arange(13))
    assert before.std() < 0.2 and after[labels == 1].min() > 0.8 and after[labels == 0].max() < 0.2


@has_data
def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op1_toxicity, op10_quality
    for query, label, fold in ((op1_toxicity, "toxic", 4), (op10_quality, "quality", 5)):
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        rows = query(spark, SF).join(labels, "doc_id").where("held_out").select("predicted", F.col(label).alias("label")).collect()
        for kind in (0, 1):
            own = [r.predicted == kind for r in rows if r.label == kind]
            assert sum(own) >= 0.93 * len(own) and len(own) > 50


def test_telling_chunks_anywhere_in_a_long_text_are_learned_from(spark):
    """Poor texts that differ from good ones only in a few places of many are told apart: training reads whole texts."""
    rng = random.Random(31)
    rows = []
    for i in range(240):
        parts = [prose(rng, 60) for _ in range(8)]
        if i % 2:
            parts[rng.randrange(8)] = "$$ !! " * 60
        rows.append((i, " ".join(parts), "en", "a"))
    docs = frame(spark, rows).drop("label", "score")
    net = fit_quality(docs, labelled(spark, [(i, 1 - i % 2) for i in range(160)]))
    got = {r.doc_id: r.q for r in score_quality(docs, net, "q").collect()}
    assert sum((got[i] >= 0.5) == (i % 2 == 0) for i in range(160, 240)) >= 74
