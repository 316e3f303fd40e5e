import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import LOWER, awkward, components, frame, prose, rows_of, words
from tidemark.llm import jaccard as J
from tidemark.llm.jaccard import jaccard_components


def sets_of(rows, n=5):
    out = []
    for _, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def expected(rows):
    sets = sets_of(rows)
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] is not None and rows[b][0] is not None
             and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(len(rows), links)
    smallest = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            smallest[c] = min(smallest.get(c, rows[i][0]), rows[i][0])
    return [(r[0], len(s), None if r[0] is None else smallest[c]) for r, s, c in zip(rows, sets, comp)]


def check(spark, rows):
    got = rows_of(jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_awkward_rows(spark):
    check(spark, awkward(random.Random(1)))


def test_empty_table(spark):
    assert rows_of(jaccard_components(frame(spark, [])), "doc_id", "n_shingles", "component_id") == []


@pytest.mark.parametrize("seed", [2, 3])
def test_chains_around_the_threshold(spark, seed):
    """Large groups of copies at all distances from each other, which one pivot cannot settle."""
    rng, rows = random.Random(seed), []
    passage = prose(rng, 55)
    for group in range(4):
        base = prose(rng, 90).split(" ")
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(text), "en", "a"))
            base = text if rng.random() < 0.4 else base  # drifts, so that the ends of a group do not link
    rows += [(len(rows) + 1 + k, f"{prose(rng, 150)} {passage} {prose(rng, 80)}", "en", "a") for k in range(30)]
    rng.shuffle(rows)
    check(spark, rows)


def test_shingles():
    same = [list(s) for s in J.shingles(pa.array(["a b c d e f", " A b  C\nd e f ", None, "", "a b", "a b c"]), 5)]
    assert same[0] == same[1] and len(same[0]) == 2 and same[2] == same[3] == [] and len(same[4]) == len(same[5]) == 1 and same[4] != same[5]


def test_bounds_of_what_two_sets_share(spark):
    """No pair that links may be ruled out by its parities or by the place of its first shared shingle."""
    rng = random.Random(5)
    emit, shared = J._entries(5, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    for _ in range(60):
        base = prose(rng, rng.randrange(5, 400)).split(" ")
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
        texts = [" ".join(base), " ".join(text + prose(rng, 8).split(" ")[:rng.randrange(0, 9)])]
        x, y = J.shingles(pa.array(texts), 5)
        both, apart = len(np.intersect1d(x, y)), len(np.setxor1d(x, y))
        odd = int(np.bitwise_count((J.parities(x) ^ J.parities(y)).view(np.uint64)).sum())
        assert odd <= apart
        if not apart or 100 * both < 75 * (both + apart):
            continue
        assert 175 * odd <= 25 * (len(x) + len(y))
        kind = np.dtype([("h", "<u8"), ("cls", "<i8"), ("at", "u1")])
        packed = [e for b in emit(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])) for e in b.column("entries").to_pylist()]
        rows = np.concatenate([np.frombuffer(e, kind) for e in packed])
        of = {J.set_key(s): {h: a for h, k, a in rows.tolist() if k == J.set_key(s)} for s in (x, y)}
        a, b = of[J.set_key(x)], of[J.set_key(y)]
        assert any(J.PLACES * 75 * (len(x) + len(y)) <= 175 * min(len(x) * (J.PLACES - a[h]), len(y) * (J.PLACES - b[h])) for h in a.keys() & b.keys())


def test_pairs_of_documents_with_a_common_passage(spark, monkeypatch):
    """Texts that share much and do not link are not compared each with each."""
    rng, rows, compared, spool = random.Random(6), [], [], J.spool
    passage = prose(rng, 78)
    rows = [(k + 1, f"{passage} {prose(rng, 20)}", "en", "a") for k in range(150)]

    def counted(df, label):
        out = spool(df, label)
        if label == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(J, "spool", counted)
    check(spark, rows)
    assert sum(compared) <= 3 * len(rows)
