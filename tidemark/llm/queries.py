"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import fresh_path, table
from tidemark.llm.embeddings import near_duplicate_vectors
from tidemark.llm.fingerprint import fingerprints
from tidemark.llm.importance import importance_resample
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.mixing import mix
from tidemark.llm.negatives import hard_negatives
from tidemark.llm.packing import pack
from tidemark.llm.pii import fit_field, personal_data
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.llm.url_filter import filter_urls
from tidemark.llm.warc import capture_history, read_archive, write_archive

#: Listed rules of the url filter.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A score from this on predicts label 1.
THRESHOLD = 0.3


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _labels(spark, sf: str, label: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.col(label).cast("int").alias("label"))


def _predicted(scored: DataFrame, held_out: Column, *more: str) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *more)


def op1_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = fit_toxicity(docs, _labels(spark, sf, "toxic").where(fold(4) != 2))
    return _predicted(score_toxicity(docs.select("doc_id", "text"), model), fold(4) == 2, "top_cosine", "evidence")


def op2_token_counts(spark, sf):
    counts = token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_url_filter(spark, sf):
    return filter_urls(table(spark, sf, "pages"), URL_RULES)


def op4_packing(spark, sf):
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark, sf):
    return mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_fingerprint(spark, sf):
    return fingerprints(table(spark, sf, "documents"))


def op7_warc(spark, sf):
    path = fresh_path(spark, "warc")
    write_archive(table(spark, sf, "pages"), path)
    history = capture_history(read_archive(spark, path))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op8_jaccard_join(spark, sf):
    return jaccard_components(table(spark, sf, "documents"))


def op9_embedding_near_dedup(spark, sf):
    return near_duplicate_vectors(table(spark, sf, "embeddings"))


def op10_quality(spark, sf):
    docs = table(spark, sf, "documents")
    net = fit_quality(docs, _labels(spark, sf, "quality").where(fold(5) != 0))
    return _predicted(score_quality(docs.select("doc_id", "text"), net), fold(5) == 0)


def op11_pii(spark, sf):
    docs = table(spark, sf, "documents")
    return personal_data(docs, fit_field(docs))


def op12_importance_resampling(spark, sf):
    drawn = importance_resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_hard_negatives(spark, sf):
    vectors = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_url_filter, op4_packing, op5_mixing, op6_fingerprint, op7_warc, op8_jaccard_join,
    op9_embedding_near_dedup, op10_quality, op11_pii, op12_importance_resampling, op13_hard_negatives)}

#: DuckDB SQL of the operators that it can express in full.
ORACLES: dict[str, str] = {
    "op9_embedding_near_dedup": """
        with recursive r as (
            select vec_id, label, [x::double for x in embedding] as v from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
        links as (
            select a.vec_id as a, b.vec_id as b from r a join r b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            where list_cosine_similarity(a.v, b.v) >= 0.93),
        reach(a, b) as (select vec_id, vec_id from r union select reach.a, links.b from reach join links on reach.b = links.a)
        select e.vec_id, coalesce(n, 0) as n_links, coalesce(c, e.vec_id) as component_id, coalesce(c, e.vec_id) = e.vec_id as kept
        from embeddings e left join (select a, count(*) as n from links group by a) k on k.a = e.vec_id
             left join (select a, min(b) as c from reach group by a) m on m.a = e.vec_id""",
    "op13_hard_negatives": """
        with r as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   [floor(256 * x::double) for x in embedding] as q
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        s as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
            from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, p.vec_id as positive_id,
               (row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id))::integer as rank,
               s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
        from p join s on s.anchor_id = p.anchor_id and not s.same
                     and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
        qualify rank <= 10""",
}
