"""URL filtering: listed rules first, then association rules mined from the urls that the list decides.

A url is a set of tokens: the labels of its host, the segments and file endings of its path, the keys and
values of its query. Spark's FP-growth finds the token combinations that come with "block" among the
listed urls; those of enough support and confidence become rules. Rules are matched by an inverted index:
each is filed under its rarest token, so a url looks at the rules of its own tokens only.

Defined results: a null url, or one without ``://``, has an empty host and path and no tokens, and is
allowed. The longest listed rule wins. Without listed urls of a verdict there are no mined rules, and
urls that the list leaves open are allowed. Repeated rows are kept. Other columns are not read. An empty table gives
no rows, and urls of any length are read whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import map_arrow, spool

#: A mined rule needs this share of the listed urls, this share of blocked ones among those it fits, and
#: at most this many tokens. Support bounds the rules, since each needs so many urls and a url has few sets of its tokens.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 0.8, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def listed(rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule of ``(verdict, "host/path")``, over columns host and path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        found = F.when(fits & F.startswith("path", F.lit(slash + path)),
                       F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: h: host labels, p: path segments, e: file ending, q: parts of the query; digits become #."""
    def parts(text: Column, kind: str, cut: str) -> Column:
        words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[0-9]+", "#"), cut), lambda w: w != "")
        return F.transform(words, lambda w: F.concat(F.lit(kind), w))
    path = path_of(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    ending = F.regexp_extract(path, r"\.[^./]+$", 0)
    return F.array_distinct(F.coalesce(F.concat(parts(host_of(url), "h:", r"\."), parts(path, "p:", "/"),
                                                parts(ending, "e:", "/"), parts(query, "q:", "&")), F.array().cast("array<string>")))


def mine_rules(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               max_tokens: int = MAX_TOKENS) -> list[tuple[tuple[str, ...], float, float]]:
    """(tokens, confidence, support) of rules for "block" from rows (tokens, verdict), best first.

    A rule adds nothing to one of part of its tokens with the same or higher confidence; such rules are removed in Spark, and
    all others are kept.
    """
    baskets = urls.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = spool(model.associationRules.where((F.col("consequent") == F.array(F.lit("=block"))) & (F.size("antecedent") <= max_tokens)
                                               & ~F.array_contains("antecedent", "=allow"))
                  .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    size = F.size("tokens")
    # each part of a rule's tokens, by the bits of a number below 2 ** size - 1
    numbered = rules.where(size > 1).select("tokens", "confidence", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), size).cast("int") - 2)).alias("bits"))
    part = F.filter("tokens", lambda t, i: F.col("bits").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    parts = numbered.select("tokens", "confidence", part.alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("least"))
    redundant = parts.join(shorter, "part").where("least >= confidence").select("tokens").distinct()
    kept = rules.join(redundant, "tokens", "left_anti").collect()
    return sorted(((tuple(r["tokens"]), r["confidence"], r["support"]) for r in kept), key=lambda r: (-r[1], len(r[0]), -r[2], r[0]))


class RuleIndex:
    """Mined rules filed under the token that the fewest of them have."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, float]]):
        uses: dict[str, int] = defaultdict(int)
        for own, _, _ in rules:
            for t in own:
                uses[t] += 1
        self.filed: dict[str, list[tuple[float, float, tuple[str, ...]]]] = defaultdict(list)
        for own, confidence, support in rules:
            self.filed[min(own, key=lambda t: (uses[t], t))].append((confidence, support, own))
        for kept in self.filed.values():
            kept.sort(key=lambda r: (-r[0], -r[1], r[2]))

    def best(self, found: list[str]) -> tuple[float, float, tuple[str, ...]] | None:
        """The fitting rule of highest confidence, then support."""
        have, best = set(found), None
        for t in found:
            for rule in self.filed.get(t, ()):
                if have.issuperset(rule[2]):
                    if best is None or (-rule[0], -rule[1], rule[2]) < (-best[0], -best[1], best[2]):
                        best = rule
                    break
        return best


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) for each row of pages (page_id, url)."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens(url).alias("tokens"))
    rows = rows.fillna("", ["host", "path"]).withColumn("found", listed(rules)).select("page_id", "host", "path", "tokens", "found.*")
    verdicts = rows.where("verdict is not null")
    sent = pages.sparkSession.sparkContext.broadcast(RuleIndex(mine_rules(verdicts, **mining)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict, mined, confidence = batch.column("verdict").to_pylist(), [], []
            for i, found in enumerate(batch.column("tokens").to_pylist()):
                rule = sent.value.best(found) if verdict[i] is None else None
                verdict[i] = verdict[i] or ("block" if rule else "allow")
                mined.append(" ".join(rule[2]) if rule else None)
                confidence.append(rule[0] if rule else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()),
                                              pa.array(mined, pa.string()), pa.array(confidence, pa.float64())],
                                             ["page_id", "host", "path", "rule", "verdict", "mined", "confidence"])

    schema = "page_id long, host string, path string, rule string, verdict string, mined string, confidence double"
    return map_arrow(rows.withColumn("page_id", F.col("page_id").cast("long")), judge, schema)
