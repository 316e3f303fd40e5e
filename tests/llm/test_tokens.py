import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from llm_helpers import awkward, frame, prose, rows_of
from tidemark.llm import tokens as T
from tidemark.llm.common import fresh_path
from tidemark.llm.packing import BestFit, pack
from tidemark.llm.token_counts import token_counts

WORD_FILE, BYTE_FILE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = ["a", "B", "é", "É", "ß", " ", "  ", "\n", "\t", "'s", "'", "don't", "1", "23", "½", "<|endoftext|>", "<|", "|", ".", "!!", "%%%", "\x1c", "中文",
          "🙂", "e\u0301", "\u0301", "İ", "Σ", "ﬁ", "\r\n", "_", "×", "x²", "\u200b", "\x85", "\x0b", "\xa0", "hello", "WORLD", "\u180e", "\u2028"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=20))
def test_same_as_the_library(text):
    word, byte = T.word_ids(WORD_FILE), T.byte_counts(BYTE_FILE)
    assert list(np.frombuffer(word.encode(text), "<u4")) == word.tokenizer.encode(text, add_special_tokens=False).ids
    assert byte.count(text) == len(byte.tokenizer.encode(text, add_special_tokens=False).ids)


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    text = prose(random.Random(1), 300)
    assert T.WordIds(WORD_FILE).encode(text * 2) == T.word_ids(WORD_FILE).encode(text * 2)
    assert T.ByteCounts(BYTE_FILE).count(text) == T.byte_counts(BYTE_FILE).count(text)


def test_counts_and_cache(spark):
    rows, cache = awkward(random.Random(5)), fresh_path(spark, "cache")
    library = Tokenizer.from_file(BYTE_FILE)
    want = sorted(((i is not None, i or 0), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)

    def got(docs):
        return sorted(((r[0] is not None, r[0] or 0), r[1], r[2]) for r in token_counts(docs, BYTE_FILE, cache).collect())

    half = frame(spark, rows[:8])
    got(half)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in rows[:8]})
    assert got(frame(spark, rows)) == want
    known = spark.read.parquet(cache)
    assert known.count() == known.select("digest").distinct().count() == len({t or "" for _, t, *_ in rows})
    assert got(frame(spark, rows)) == want and spark.read.parquet(cache).count() == known.count()  # nothing new
    assert got(frame(spark, [])) == []


def test_another_tokenizer_has_its_own_counts(spark, tmp_path):
    cache = fresh_path(spark, "cache")
    other = tmp_path / "other.json"
    other.write_bytes(open(BYTE_FILE, "rb").read() + b"\n")
    docs = frame(spark, [(1, "a b", None, None)])
    token_counts(docs, BYTE_FILE, cache).collect()
    token_counts(docs, str(other), cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = BestFit(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = BestFit(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)] and bins.place(8) == (2, 0)  # bin 1, the fullest, closes
    assert bins.place(2) == (2, 8) and bins.place(3) == (0, 6)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_best_fit_never_overfills(lengths, open_bins):
    bins, used = BestFit(64, open_bins), {}
    for n in lengths:
        at, offset = bins.place(n)
        assert used.get(at, 0) == offset
        used[at] = offset + n
        assert used[at] <= 64 and bins.held <= open_bins


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(spark, capacity):
    rng = random.Random(6)
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randrange(1, 300)), "en", "a") for i in range(300)]
    out = pack(frame(spark, rows).repartition(5), WORD_FILE, capacity, open_bins=8, with_ids=True).collect()
    library, docs = Tokenizer.from_file(WORD_FILE), []
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        docs += [(i or -1, k, s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()), ids[s:s + capacity].tobytes())
                 for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == sorted(docs)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    assert len(bins) <= 1.06 * -(-sum(d[3] for d in docs) // capacity) + 2


def test_packing_an_empty_table(spark):
    assert rows_of(pack(frame(spark, []), WORD_FILE), "doc_id", "sequence_id") == []
