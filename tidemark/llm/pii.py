"""Personal data: plain patterns, and a semi-Markov conditional random field that resolves what they leave.

The patterns give the base spans: e-mail addresses, dotted network addresses, card numbers and phone numbers. Each takes
the longest run it can and drops it whole if a check fails, so two card numbers beside one another, or a phone number followed by
other digits, are lost. The field reads the stretches of a text that could hold personal data. A stretch is a row
of tokens (digits, letters, single other characters); a segment is either one token outside any span or a whole span of up to
``MOST_TOKENS`` tokens of one kind. Features look at a whole candidate: its shape, its digits, its checks, what stands on
either side, and the segment before. A dynamic program over (end, kind) with spans of bounded length finds the segmentation of the
highest score, so boundaries and kinds are chosen together. Its spans are added where no base span lies.

The weights maximise the likelihood of the base spans in a sample of at most ``SAMPLE`` different stretches of at most ``MOST_CHARS`` characters for each kind and
for none (the smallest by hash). Stretches in which a run was dropped for having too many digits are left out of it, for their right answer is not
known. Stretches of like shape have one lattice, which is kept once with their number.

Defined results: null is the empty text, and a text without personal data has empty spans and the hash of the empty list. Texts of
any length are read whole. Offsets count code points. Spans are ordered by start, then kind as listed; base spans of different kinds may
overlap. Repeated rows and rows that share a doc_id, or have none, are judged each by its own text. Without any stretch to learn from,
as in an empty table, only base spans are given. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import map_arrow, pieces_of, spool

# Kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)

#: Tokens of the longest span that the field can find, stretches learned from per kind, and characters of the longest of them.
MOST_TOKENS, SAMPLE, MOST_CHARS = 40, 600, 160
_EPOCHS, _RATE, _SHRINK = 60, 0.3, 0.001
#: Tokens of a region whose segments are kept at once.
_SHORT = 200

_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"\+?[0-9][\x20().0-9+-]*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_TRIM = " ().+-"

Span = tuple[str, int, int]
Segment = tuple[int, int, int, tuple[str, ...]]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: the part before it cannot hold another @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from each run of dotted numbers."""
    for run in _DOTTED.finditer(text, start, end):
        numbers = [m.span() for m in _NUMBER.finditer(text, *run.span())]
        for i in range(0, len(numbers) - 3, 4):
            yield numbers[i][0], numbers[i + 3][1]


def _stretches(text: str) -> list[tuple[int, int]]:
    """Runs of digits and what joins them, with enough digits for some kind."""
    long = (m for m in _DIGITS.finditer(text) if m.end() - m.start() > 6)
    return [m.span() for m in long if m.group().count(".") >= 3 or sum(map(m.group().count, "0123456789")) >= PHONE_DIGITS[0]]


def base_spans(text: str, stretches: list[tuple[int, int]] | None = None) -> tuple[list[Span], list[tuple[int, int]]]:
    """(spans by start and kind, runs dropped for having too many digits)."""
    spans, dropped = [("email", a, b) for a, b in _emails(text)], []
    for start, end in _stretches(text) if stretches is None else stretches:
        spans += [("ip", a, b) for a, b in _addresses(text, start, end) if _octets(text[a:b])]
        for kind, pattern, (least, most) in (("card", _CARD, CARD_DIGITS), ("phone", _PHONE, PHONE_DIGITS)):
            for m in pattern.finditer(text, start, end):
                digits = _only_digits(m.group())
                if least <= len(digits) <= most and (kind != "card" or luhn(digits)):
                    spans.append((kind, *m.span()))
                elif len(digits) > most:
                    dropped.append(m.span())
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))), dropped


def _regions(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of a text that the field reads: stretches of digits, and what surrounds each @, with a character on either side.

    Those that touch are one.
    """
    found = []
    for a, b in stretches:
        found.append((a - (a > 0 and text[a - 1] == "("), a + len(text[a:b].rstrip(_TRIM))))
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a and text[a - 1] in _LOCAL:
            a -= 1
        while b < len(text) and text[b] in _LOCAL:
            b += 1
        found.append((a, b))
        at = text.find("@", b)
    return _merged((max(a - 1, 0), min(b + 1, len(text))) for a, b in found)


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a text that spans cover together, in order."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


# The field

def _class(c: str) -> str:
    if not c:
        return "edge"
    return "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "@.+-()" else "other"


def _shape(text: str) -> str:
    """Runs of digits by their length, runs of letters as one mark, anything else as it is."""
    return _TOKEN.sub(lambda m: f"<{len(m.group())}>" if m.group()[0] in "0123456789" else "a" if m.group()[0].isalpha() else m.group(), text)


def _may_be(kind: str, text: str, digits: int) -> bool:
    """What makes a piece of text a thing of this kind at all; the field tries no others."""
    if kind == "email":
        local, at, domain = text.partition("@")
        return bool(at and local) and _LOCAL.issuperset(local) and _DOMAIN.fullmatch(domain) is not None
    if text[-1] not in "0123456789":
        return False
    if kind == "ip":
        return text.count(".") == 3 and digits + 3 == len(text) and text[0] != "." and ".." not in text and _octets(text)
    if kind == "card":
        return CARD_DIGITS[0] <= digits <= CARD_DIGITS[1] and _CARD.fullmatch(text) is not None and luhn(_only_digits(text))
    return PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1] and text[0] in "+(" and "+" not in text[1:]


def _span_features(kind: str, text: str, digits: int, left: str, right: str) -> tuple[str, ...]:
    features = (kind, f"{kind} after {_class(left)}", f"{kind} before {_class(right)}")
    if kind in ("email", "ip"):
        return features
    shape = _shape(text)
    return (*features, f"{kind} shape {shape}", f"{kind} digits {digits}", f"{kind} groups {shape.count('<')}", f"{kind} first {text[0] if kind == 'phone' else ''}")


def token_places(text: str, start: int, end: int) -> list[int]:
    """Where the tokens of a region begin, and its end."""
    return [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]


def segments_of(text: str, places: list[int]) -> Iterator[Segment]:
    """(first token, end token, kind or -1, features) of all segments of a region, in the order of their ends."""
    digits = [0]
    for a, b in zip(places, places[1:]):
        digits.append(digits[-1] + (b - a if text[a] in "0123456789" else 0))
    for j in range(1, len(places)):
        yield j - 1, j, -1, ("out " + _class(text[places[j - 1]]),)
        last = text[places[j] - 1]
        if not last.isalnum():
            continue
        right = text[places[j]] if places[j] < len(text) else ""
        for i in range(j - 1, max(j - MOST_TOKENS, 0) - 1, -1):
            first, n = text[places[i]], digits[j] - digits[i]
            piece = text[places[i]:places[j]]
            if "@" not in piece and (n > CARD_DIGITS[1] or len(piece) - n > MOST_TOKENS):
                break
            left = text[places[i] - 1] if places[i] else ""
            for k, kind in enumerate(KINDS):
                if (first in _LOCAL or first == "(") and _may_be(kind, piece, n):
                    yield i, j, k, _span_features(kind, piece, n, left, right)


def decode(n: int, segments: Iterable[Segment], weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """Spans (first token, end token, kind) of the best segmentation; states are (end, kind of the last segment)."""
    kinds = len(KINDS) + 1
    best = np.full((n + 1, kinds), -np.inf)
    best[0, -1] = 0.0
    back: dict[tuple[int, int], tuple[int, int]] = {}
    step = _transitions(weights)
    for i, j, k, features in segments:
        own = sum(weights.get(f, 0.0) for f in features)
        arrive = best[i] + step[:, k]
        before = int(arrive.argmax())
        if arrive[before] + own > best[j, k]:
            best[j, k] = arrive[before] + own
            back[j, k % kinds] = (i, before)
    found, at = [], (n, int(best[n].argmax()))
    while at[0]:
        before = back[at]
        if at[1] < len(KINDS):
            found.append((before[0], at[0], at[1]))
        at = before
    return found[::-1]


def _step_name(a: int, b: int) -> str:
    return f"then {a} {b}"


def _transitions(weights: dict[str, float]) -> np.ndarray:
    kinds = len(KINDS) + 1
    return np.array([[weights.get(_step_name(a, b), 0.0) for b in range(kinds)] for a in range(kinds)])


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return top if top == -np.inf else top + np.log(np.exp(x - top).sum())


def _expected(n: int, arcs, score: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log of the sum over all segmentations, chance of each segment, expected number of each step)."""
    kinds = len(step)
    ahead, after = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
    ahead[0, -1], after[n] = 0.0, 0.0
    for s, (i, j, k) in enumerate(arcs):
        ahead[j, k] = np.logaddexp(ahead[j, k], _log_sum(ahead[i] + step[:, k]) + score[s])
    for s in range(len(arcs) - 1, -1, -1):
        i, j, k = arcs[s]
        after[i] = np.logaddexp(after[i], step[:, k] + score[s] + after[j, k])
    total, chance, steps = _log_sum(ahead[n]), np.zeros(len(arcs)), np.zeros_like(step)
    for s, (i, j, k) in enumerate(arcs):
        through = np.exp(ahead[i] + step[:, k] + score[s] + after[j, k] - total)
        chance[s] = through.sum()
        steps[:, k] += through
    return float(total), chance, steps


def fit_weights(examples: list[tuple[int, tuple, tuple[int, ...], int]], epochs: int = _EPOCHS) -> dict[str, float]:
    """Weights that maximise the likelihood of examples (tokens, segments, the right segments, how often it occurs)."""
    names: dict[str, int] = {}
    prepared, kinds = [], len(KINDS) + 1
    for n, segments, right, times in examples:
        arcs = [(i, j, k % kinds) for i, j, k, _ in segments]
        ids = [[names.setdefault(f, len(names)) for f in features] for *_, features in segments]
        steps, before = np.zeros((kinds, kinds)), kinds - 1
        for s in right:
            steps[before, arcs[s][2]] += 1
            before = arcs[s][2]
        flat = np.concatenate([np.array(x) for x in ids])
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        truth = np.zeros(len(arcs))
        truth[list(right)] = 1
        prepared.append((n, arcs, flat, owner, truth, steps, float(times)))
    weights, step = np.zeros(len(names)), np.zeros((kinds, kinds))
    moved = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, step)]
    share = sum(p[-1] for p in prepared)
    for epoch in range(1, epochs + 1):
        slope, slope_step = -_SHRINK * weights, -_SHRINK * step
        for n, arcs, flat, owner, truth, steps, times in prepared:
            score = np.bincount(owner, weights[flat], len(arcs))
            _, chance, expected = _expected(n, arcs, score, step)
            np.add.at(slope, flat, (times / share * (truth - chance))[owner])
            slope_step += times / share * (steps - expected)
        for x, g, (m, v) in zip((weights, step), (slope, slope_step), moved):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += _RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-8)
    found = {name: float(weights[i]) for name, i in names.items()}
    return found | {_step_name(a, b): float(step[a, b]) for a in range(kinds) for b in range(kinds)}


def _example(text: str, start: int, end: int):
    """A region's lattice and its right segments by the base spans, or None if the base does not know."""
    spans, dropped = base_spans(text)
    inside = [s for s in spans if s[1] < end and s[2] > start]
    if any(a < end and b > start for a, b in dropped) or any(a[2] > b[1] for a, b in zip(inside, inside[1:])):
        return None
    places = token_places(text, start, end)
    segments = tuple(segments_of(text, places))
    number = {(i, j, k): s for s, (i, j, k, _) in enumerate(segments)}
    token, right, at = {p: t for t, p in enumerate(places)}, [], 0
    for kind, a, b in inside:
        if a not in token or b not in token or (token[a], token[b], KINDS.index(kind)) not in number:
            return None
        right += [number[t, t + 1, -1] for t in range(at, token[a])] + [number[token[a], token[b], KINDS.index(kind)]]
        at = token[b]
    right += [number[t, t + 1, -1] for t in range(at, len(places) - 1)]
    return len(places) - 1, segments, tuple(right)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regions of each text with the character on either side, and the kind of the first base span in them."""
    for batch in batches:
        for piece in pieces_of(batch):
            kinds, regions = [], []
            for text in piece.column("text"):
                text = text.as_py() or ""
                stretches = _stretches(text)
                for a, b in _regions(text, stretches):
                    region = text[max(a - 1, 0):b + 1]
                    if b - a <= MOST_CHARS:
                        spans, _ = base_spans(region)
                        kinds.append(spans[0][0] if spans else "none")
                        regions.append(region)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.string()), "region": pa.array(regions, pa.string())})


def fit_field(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float] | None:
    """The weights of the field learned from a bounded sample of the stretches of ``docs``; None if there are none."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    regions = spool(map_arrow(text, _sampled, "kind string, region string").distinct(), "pii-regions")
    order = (F.xxhash64("region"), "region")
    taken = [r.region for kind in (*KINDS, "none") for r in regions.where(F.col("kind") == kind).orderBy(*order).limit(sample).collect()]
    counted: Counter = Counter()
    for region in taken:
        for a, b in _regions(region, _stretches(region)):
            example = _example(region, a, b)
            if example:
                counted[example] += 1
    return fit_weights([(*example, n) for example, n in counted.items()]) if counted else None


class Finder:
    """Base spans and those that the field adds."""

    def __init__(self, weights: dict[str, float] | None):
        self.weights = weights
        self._decoded = lru_cache(1024)(lambda n, segments: decode(n, segments, self.weights))

    def __reduce__(self):
        return Finder, (self.weights,)

    def _decode(self, text: str, places: list[int]) -> list[tuple[int, int, int]]:
        """Short regions are often alike; a long one is read as its segments arise."""
        if len(places) > _SHORT:
            return decode(len(places) - 1, segments_of(text, places), self.weights)
        return self._decoded(len(places) - 1, tuple(segments_of(text, places)))

    def find(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, added spans)"""
        stretches = _stretches(text)
        base, added = base_spans(text, stretches)[0], []
        taken = _merged((a, b) for _, a, b in base)
        ends = [b for _, b in taken]
        for start, end in _regions(text, stretches) if self.weights is not None else ():
            places = token_places(text, start, end)
            for i, j, k in self._decode(text, places):
                at = bisect_right(ends, places[i])
                if at == len(taken) or taken[at][0] >= places[j]:
                    added.append((KINDS[k], places[i], places[j]))
        return base, added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def _found(finder: Finder):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                out: dict[str, list] = {c: [] for c in (*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans")}
                for text in piece.column("text"):
                    base, added = finder.find(text.as_py() or "")
                    for kind in KINDS:
                        out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                    out["n_added"].append(len(added))
                    out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    out["spans"].append(_joined(base + added))
                columns = [pa.array(v, pa.int64() if c.startswith("n_") else pa.string()) for c, v in out.items()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], names=["doc_id", *out])

    return found


def personal_data(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) for each row of docs (doc_id, text).

    The counts by kind are those of the base spans, ``n_added`` is the number of spans from the field, ``spans`` holds all.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "n_added long, base_sha256 string, spans string"
    return map_arrow(rows, _found(Finder(weights)), shape)
