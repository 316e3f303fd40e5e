"""Small documents with the awkward cases, and plain versions of what the operators do."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, cls int, size string, label double"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies and repeated rows."""
    base, long = prose(rng, 60), prose(rng, 30_000)
    near = base.split(" ")
    near[30] = "changed"
    return [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "one", "en", "b"), (5, "ONE", "fr", "b"),
            (6, "one two three four five", "en", None), (7, "One Two  three\nfour five", None, "a"), (8, base, "en", "a"),
            (9, " ".join(near), "en", "c"), (10, base.upper(), "de", "c"), (10, base.upper(), "de", "c"), (11, long, "en", "a"),
            (12, long + " end", "en", "b"), (None, base, "en", "a"), (None, None, None, None), (13, "é\u0301 ß\u00a0x 中文 🙂 <|endoftext|>", "en", "d"),
            (14, "x" * 5000, "en", "d"), (15, "\x1c\x85\u2028", "en", "d"), (16, base + " " + prose(rng, 10), "en", "a")]


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 7, "y", 0.5) for i, t, lang, source in rows], SCHEMA)


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def rows_of(df, *columns):
    key = lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, float) else (True, "", x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
