import hashlib
import math
import random
import re
import zlib

import pytest

from llm_helpers import awkward, frame, prose
from tidemark.llm import importance as I
from tidemark.llm.importance import feature_crcs, importance_resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(lower)
    return words, [b" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected(rows, target, percent=5, least=20):
    """Plain Python: (doc_id, n_features, weight, score, rank)."""
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[zlib.crc32(f) % 10_000] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10_000) / ((s[b] + 1) * (sum(t) + 10_000)))) for b in range(10_000)]
    out = []
    for i, text, *_ in rows:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[:math.floor(percent * len(able) / 100)], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def by_value(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


def check(spark, rows, target, **more):
    goal = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, weight string")
    got = importance_resample(frame(spark, rows), goal, **more).drop("n_words")
    assert by_value(map(tuple, got.collect())) == by_value(expected(rows, target, **({"percent": more["percent"]} if "percent" in more else {})))


def test_awkward_texts(spark):
    rng = random.Random(3)
    rows = awkward(rng) + [(100 + k, prose(rng, rng.randrange(15, 60), 50), "en", "a") for k in range(150)]
    check(spark, rows, [prose(rng, 40, 20), None, "", "One-two é_ü\x7f3"], percent=30)


def test_only_the_words_of_the_target_lift_a_text(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 40, 300 if k % 10 else 20), "en", "a") for k in range(400)]
    target = [prose(rng, 100, 20) for _ in range(20)]
    check(spark, rows, target)
    ranked = importance_resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")).where("rank is not null")
    assert {r.doc_id % 10 for r in ranked.collect()} == {0}


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_do_not_change_features(monkeypatch, piece):
    text = ("Ab1-" + "é" * 30 + " x  y\n" + "w" * 100 + " z " + "p.q" * 20).encode()
    monkeypatch.setattr(I, "PIECE", piece)
    got = [crc for _, runs in feature_crcs(text) for run in runs for crc in run]
    assert sorted(got) == sorted(zlib.crc32(f) for f in features(text.decode())[1])


def test_empty_tables_and_equal_rows(spark):
    check(spark, [], ["one two"])
    text = " ".join(f"w{k}" for k in range(25))
    check(spark, [(1, text, "en", "a")] * 40 + [(None, text, "en", "a")] * 3, [], percent=50)
