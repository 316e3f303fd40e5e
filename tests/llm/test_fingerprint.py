import hashlib
import random
import re


from llm_helpers import awkward, frame, prose
from tidemark.llm import fingerprint as P
from tidemark.llm.fingerprint import fingerprints


def paragraphs(text):
    return set(re.findall(r"[^\n.!?]{1,200}", text or ""))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), (r[1] or "").encode()))
    out = []
    for k, (i, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[:n - n // 3] + following[:n // 3]
        out.append((i or -1, n, hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, following), 9)))
    return sorted(out)


def check(spark, rows):
    got = fingerprints(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected(rows)
    return got


def test_awkward_rows(spark):
    rows = awkward(random.Random(1))
    got = check(spark, rows)
    prints = {}
    for r in got:
        if r.doc_id == 10:
            prints.setdefault(10, set()).add(r.fingerprint)
    assert len(prints[10]) == 1


def test_many_buckets_and_ties(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)
    rng = random.Random(2)
    rows = [(rng.choice([5, 5, 5, i, 10**12 + i]), prose(rng, rng.randrange(0, 80)).replace("\n", ". "), "en", "a") for i in range(120)]
    check(spark, rows)


def test_retries_recover_what_a_small_sketch_cannot(spark, monkeypatch):
    monkeypatch.setattr(P, "CELLS", 4)
    monkeypatch.setattr(P, "ROUNDS", 6)
    rng = random.Random(3)
    check(spark, [(i, prose(rng, 120).replace(",", "."), "en", "a") for i in range(30)])


def test_the_fingerprint_holds_its_digests(spark):
    """From the text of a fingerprint alone, plain peeling recovers every digest of the document; it grows with the paragraphs."""
    rng = random.Random(4)
    rows = [(i, ". ".join(prose(rng, 4) for _ in range(n)), "en", "a") for i, n in enumerate((0, 1, 5, 31, 33, 100, 700))]
    docs = frame(spark, rows)
    digests = {r.doc_id: set(r.d) for r in docs.select("doc_id", P.paragraph_digests(docs.text).alias("d")).collect()}
    mask = (1 << 64) - 1
    unsigned = {d & mask: d for own in digests.values() for d in own}
    every = spark.createDataFrame([(d,) for d in unsigned.values()], "d long")
    checks = {r[0] & mask: r[1] & mask for r in every.select("d", P._check(every.d)).collect()}
    for r in fingerprints(docs).collect():
        n, pages, *cells = r.fingerprint.split()
        left = {int(c[0], 16): [int(c[1]), int(c[2], 16), int(c[3], 16)] for c in (x.split(":") for x in cells)}
        assert int(n) == len(digests[r.doc_id]) and int(pages) * P.PAGE >= int(n)
        found = set()
        while pure := {x for k, x, c in left.values() if k == 1 and checks.get(x) == c} - found:
            places = spark.createDataFrame([(unsigned[x],) for x in pure], "d long")
            for row in places.select("d", *[P._place(places.d, t, P.F.lit(int(pages))) for t in range(3)]).collect():
                x = row[0] & mask
                found.add(x)
                for at in row[1:]:
                    cell = left[at]
                    cell[0], cell[1], cell[2] = cell[0] - 1, cell[1] ^ x, cell[2] ^ checks[x]
        assert {unsigned[x] for x in found} == digests[r.doc_id] and not any(any(c) for c in left.values())


def test_one_row_and_none(spark):
    check(spark, [(4, "a. b. c. d", None, None)])
    assert fingerprints(frame(spark, [])).collect() == []


def test_recovered_digests(spark):
    """Peeling finds the very digests that differ."""
    pair = spark.createDataFrame([(0, 1, 0, 2, list(range(100, 140)), list(range(110, 145)))], "bkt int, rid int, pair int, pages long, mine array<long>, theirs array<long>")
    rows = P._peeled(P._cells(pair), digests=True).collect()
    assert {(r.own, r.cell) for r in rows} == {(d, P._GONE) for d in range(100, 110)} | {(d, P._COME) for d in range(140, 145)}
    assert [tuple(r) for r in P._differences(pair).collect()] == [(0, 1, 0, 10, 5, 0)]


def test_no_python_and_no_shuffle_after_bucketing(spark):
    plan = fingerprints(frame(spark, awkward(random.Random(1))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
