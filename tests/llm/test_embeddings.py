import math
import random

import numpy as np
import pytest

from llm_helpers import components
from tidemark.llm import embeddings as E
from tidemark.llm.embeddings import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, cls int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def expected(rows, similarity=0.93):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(np.array(v, np.float32), float)
        return v / np.linalg.norm(v)

    units = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None
             and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= similarity]
    comp, n = components(len(rows), links), [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    first = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            first[c] = min(first.get(c, rows[i][0]), rows[i][0])
    return [(r[0], n[i], None if r[0] is None else first[comp[i]], r[0] is None or r[0] == first[comp[i]]) for i, r in enumerate(rows)]


def check(spark, rows, **more):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = [tuple(r) for r in near_duplicate_vectors(frame(spark, rows), **more).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def near(rng, v, far):
    out = np.array(v) + rng.normal(size=len(v)) * far / math.sqrt(len(v))
    return [float(x) for x in out / np.linalg.norm(out)]


def clustered(seed, dims=32, groups=6, each=25):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = near(rng, [0.0] * dims, 1.0)
        for _ in range(each):
            rows.append((len(rows), near(rng, base, rng.choice([0.1, 0.3, 0.37, 0.4])), int(rng.integers(0, 2))))
    rows += [(len(rows) + k, near(rng, [0.0] * dims, 1.0), k % 3) for k in range(100)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [1, 4, 8])
def test_clusters_around_the_threshold(spark, blocks):
    check(spark, clustered(1), blocks=blocks)


def test_chunks_meet_pairwise(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 20)
    check(spark, clustered(2))


def test_groups_of_a_hot_label_are_bounded(spark, monkeypatch):
    """One label whose cells hold nearly all of it: no group has more than two chunks, and small labels are not cut."""
    def limited(similarity, blocks, narrow, compare=E._compare):
        own = compare(similarity, blocks, narrow)

        def limit(key, rows):
            assert rows.num_rows <= 2 * 50 * 1.5, rows.num_rows  # classes are dealt to chunks by hash
            assert key[0].as_py() == 1 or key[5].as_py() == 0
            return own(key, rows)

        return limit

    monkeypatch.setattr(E, "CHUNK", 50)
    monkeypatch.setattr(E, "_compare", limited)
    monkeypatch.setattr(E, "_PARTNERS", 16)
    rows = [(i, v, 1) for i, v, _ in clustered(3, groups=4, each=100)]
    check(spark, rows + [(i + 10_000, v, 2) for i, v, _ in rows[:40]])


@pytest.mark.parametrize("element", ["double", "float"])
def test_pairs_on_the_threshold(spark, element):
    """Cosines of exactly 0.93 link, the next smaller ones do not."""
    rng, rows = random.Random(6), []
    for k in range(200):
        v, places = [0.0] * 32, rng.sample(range(32), 6)
        for place, x in zip(places, (93, 36, 7, 2, 1, 1)):
            v[place] = float(x)
        axis = [0.0] * 32
        axis[places[0]] = rng.choice([1.0, 2.0, 0.5])
        below = v.copy()
        below[places[1]] += 1e-4  # in double precision as in single: a cosine just below
        rows += [(3 * k, v, k), (3 * k + 1, axis, k), (3 * k + 2, below, k + 1000), (1000 + 3 * k, axis, k + 1000)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(df).collect()}
    assert [got[3 * k] for k in range(200)] == [got[3 * k + 1] for k in range(200)] == [1] * 200
    assert [got[3 * k + 2] for k in range(200)] == [0] * 200


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.6, 0.8, 0.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 0.0], 1),
            (9, [inf, 1.0, 0.0], 1), (10, [0.6, None, 0.0], 1), (None, v, 1), (11, [6.0, 8.0, 0.0], 1), (12, [-0.6, -0.8, 0.0], 1), (13, [0.6, 0.8], 1),
            (14, [0.6, 0.8, -0.0], 1), (15, [1e-30, 1.3e-30, 0.0], 1), (16, [3e37, 4e37, 0.0], 1), (17, [1.0], 1), (18, [2.0], 1), (19, [-2.0], 1)]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_budgets_add_up():
    for dims, blocks in ((64, 4), (10, 4), (3, 8), (1, 4)):
        assert sum(E.budgets(dims, blocks, 0.93)) == pytest.approx(0.14) and len(E.budgets(dims, blocks, 0.93)) == min(dims, blocks)
    q = E.rotation(12)
    assert np.allclose(q @ q.T, np.eye(12))
