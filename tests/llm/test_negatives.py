import random

import numpy as np
import pytest

from tidemark.llm import negatives as N
from tidemark.llm.negatives import hard_negatives, pack, products, read_sorted, unpack, window

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, anchor_id int, q int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)


def expected(rows, positives=5, negatives=10):
    ok = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    for a, (i, q, label) in enumerate(ok):
        if i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, p)), j, other) for b, (j, p, other) in enumerate(ok) if b != a and len(p) == len(q)),
                        key=lambda s: s[:2])
        for minus, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:negatives]
            out += [(i, j, rank, s[1], -minus, -s[0]) for rank, s in enumerate(fit, 1)]
    return out


def check(spark, rows, **more):
    got = [tuple(r) for r in hard_negatives(frame(spark, rows), **more).collect()]
    assert sorted(got) == sorted(expected(rows, **{k: v for k, v in more.items() if k in ("positives", "negatives")}))
    return got


def clusters(seed, n=900, dims=12, labels=4, copies=True):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    rows = [(int(i), [float(x) for x in centre + rng.normal(size=dims)], int(rng.integers(0, labels))) for i in rng.permutation(n)]
    if copies:  # ties: a third of the rows are one vector
        rows = [(i, [0.5] * dims, label) if i % 3 == 0 else (i, v, label) for i, v, label in rows]
    return rows


def test_against_all_pairs(spark):
    assert len(check(spark, clusters(1))) > 300
    check(spark, clusters(2, labels=2, copies=False), positives=2, negatives=3)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 100)
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "_TILE", 2)
    check(spark, clusters(3))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    v, w = [0.6, 0.8, 0.0], [0.3, 0.3, 0.1]
    rows = [(100, v, 1), (100, v, 1), (200, w, 1), (300, v, None), (400, None, 1), (500, [], 1), (600, [0.0, 0.0, 0.0], 1), (700, [nan, 1.0, 0.0], 2),
            (800, [inf, 1.0, 0.0], 2), (900, [0.6, None, 0.0], 2), (None, w, 2), (1, w, 2), (2, [0.5, 0.5, 0.0], 2), (2, [0.5, 0.5, 0.0], 2),
            (3, [-0.6, -0.8, 0.0], 2), (4, [0.6, 0.8], 2), (5, [], 2), (0, v, 3), (-100, [-0.1, 0.2, 0.3], 1), (6, [0.0, 0.0, 0.0], 2)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(100, v, 1)])


def test_huge_components(spark):
    rows = [(100, [2.0 ** 22, 1.0], 1), (1, [2.0 ** 22 + 16, 3.0], 1), (2, [2.0 ** 21, 1.0], 2), (3, [2.0 ** 21 + 8, 0.0], 2)]
    assert len(check(spark, rows)) == 2


def test_products_are_exact():
    rng = random.Random(5)
    a = np.array([[rng.randrange(-2 ** 40, 2 ** 40) for _ in range(6)] for _ in range(5)])
    b = np.array([[rng.randrange(-2 ** 18, 2 ** 18) for _ in range(6)] for _ in range(4)])
    assert products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]


@pytest.mark.parametrize("score", [-7, 0, 1, 3, 10, 10 ** 17 + 3])
def test_windows_hold_what_they_should(score):
    least, most = window(score)
    for n in {least - 1, least, most, most + 1}:
        assert (least <= n <= most) == (30 * score <= 100 * n <= 90 * score)


def test_keys_sort_as_their_parts():
    parts = [(a, s, k, i) for a in (-5, 0, 7) for s in (-2 ** 62, -1, 0, 9, 2 ** 62) for k in (0, 1) for i in (-3, 0, 2 ** 40)]
    assert [unpack(x) for x in sorted(pack(*p) for p in parts)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_the_stream_is_read_as_it_comes():
    """The iterator gives rows before it has seen the whole anchor."""
    def keys():
        yield pack(1, 100, 0, 7), 55
        for i in range(3):
            yield pack(1, 80, 1, i), 55
        raise AssertionError("read ahead")

    rows = read_sorted(keys())
    assert [next(rows) for _ in range(3)] == [(55, 7, i + 1, i, 100, 80) for i in range(3)]
