import gzip
import io
import random

import pytest
from hypothesis import given, strategies as st

from tidemark.llm.common import fresh_path
from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import filter_urls, mine_rules, tokens
from tidemark.llm.warc import LoserTree, capture_history, digest_of, read_archive, records_in, write_archive
from pyspark.sql import functions as F


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:at], rest[at:]
    end = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def listed(host, path):
    best = (None, None)
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def urls(n):
    rng = random.Random(8)
    made = [f"https://{rng.choice(['m.', 'www.', ''])}{rng.choice(['ads', 'news'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.randrange(3000)}"
            f"{rng.choice(['', '.html', '?utm=1', '#top'])}" for _ in range(n)]
    return made + [None, "", "no url", "://", "HTTP://EXAMPLE.ORG", "http://example.org/es/x", "x://ÄB.org/p?q#f", "http://notorg/", "http://a.org?x=/de/", "http://com/de/\n"]


def test_listed_rules_and_mined_rules(spark):
    rows = urls(800)
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(rows)] + [(3, rows[3], 1)], "page_id long, url string, verdict int")
    out = filter_urls(pages, URL_RULES).collect()
    assert len(out) == len(rows) + 1
    sets = {r.page_id: set(r.t) for r in pages.select("page_id", tokens(F.col("url")).alias("t")).collect()}
    baskets = [(sets[i], listed(*split(u))[1]) for i, u in enumerate(rows)] + [(sets[3], listed(*split(rows[3]))[1])]
    known = [(s, v) for s, v in baskets if v]
    for r in out:
        host, path = split(rows[r.page_id])
        rule, verdict = listed(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert r.verdict == verdict and r.mined is None
        elif r.mined:
            need = set(r.mined.split(" "))
            fits = [v for s, v in known if need <= s]
            assert r.verdict == "block" and need <= sets[r.page_id] and fits.count("block") / len(fits) == pytest.approx(r.confidence)
        else:
            assert r.verdict == "allow"
    mined = mine_rules(spark.createDataFrame([(sorted(s), v) for s, v in known], "tokens array<string>, verdict string"))
    assert any(r.mined for r in out)
    for r in out:  # brute force over all rules
        if r.rule is None:
            fitting = [m for m in mined if set(m[0]) <= sets[r.page_id]]
            assert bool(fitting) == (r.verdict == "block") and (not fitting or max(m[1] for m in fitting) == r.confidence)


def test_urls_of_an_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
    only = filter_urls(spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id long, url string"), URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in only) == [(0, "", "", None, "allow"), (1, "a.net", "/x", None, "allow")]


@given(st.lists(st.lists(st.integers(0, 30)).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_archive_round_trip(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "same é body", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "x" * 300_000, "\r\n\r\n", "🙂"]
    rows = [(i, f"https://site{i % 7}.org/p{i % 11}\r\nX: 1" if i % 5 else None, rng.choice(texts) if i % 3 else f"own {i}", "z") for i in range(150)]
    rows += [rows[6], rows[7], (None, "http://a/", "same é body", None), (None, None, "only without id", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(6)
    path = fresh_path(spark, "warc")
    write_archive(pages, path)
    out = capture_history(read_archive(spark, path)).collect()
    largest = {}
    for page, _, html, _ in rows:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", -1), page)

    def key(r):
        return tuple((x is not None, str(x)) for x in r)

    want = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        to = largest.get(html or "")
        revisit = to is not None and to != page
        want.append((page, len(body), digest_of(body), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in out]
    assert order == sorted(order)


def test_small_payloads_are_never_revisits(spark):
    path = fresh_path(spark, "warc")
    write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string"), path, revisit_from=3)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in read_archive(spark, path).collect()) == [
        (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_archive_of_an_empty_table(spark):
    path = fresh_path(spark, "warc")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert capture_history(read_archive(spark, path)).collect() == []


def test_a_cut_archive_is_an_error():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(at, n, block) for at, n, _, block in records_in(io.BytesIO(good * 2))] == [(0, len(good), b"ab"), (len(good), len(good), b"ab")]
    with pytest.raises(ValueError):
        list(records_in(gzip.open(io.BytesIO(gzip.compress(good[:-3])))))
