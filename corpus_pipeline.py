"""From raw documents to packed training sequences: each stage reads what the one before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Empty tables pass through every stage. Without labels the filters have nothing to judge by and keep all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import free_name, spool, table
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.packing import pack
from tidemark.llm.quality import fit_quality, score_quality
from tidemark.llm.toxicity import fit_toxicity, score_toxicity

#: Toxic from this score on; good from this score on.
TOXIC, GOOD = 0.3, 0.3


def _labels(spark, sf_dir: str, label: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the nearest labelled examples call toxic."""
    model = fit_toxicity(docs, _labels(spark, sf_dir, "toxic"))
    score, *more = (free_name(docs, n) for n in ("_score", "_cosine", "_evidence"))
    scored = score_toxicity(docs, model, (score, *more))
    return (scored.where(F.col(score) < TOXIC) if model.terms else docs).select(*docs.columns)


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the byte network calls poor."""
    net, score = fit_quality(docs, _labels(spark, sf_dir, "quality")), free_name(docs, "_score")
    scored = score_quality(docs, net, score)
    return (scored.where(F.col(score) >= GOOD) if net.constant is None else docs).select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies, once.

    A document is a row by its doc_id and text, so rows that share a doc_id and not the text are judged each by its own. Of rows
    that share both one stays. Rows without doc_id stay.
    """
    known = docs.where("doc_id is not null")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = spool(jaccard_components(known.select(row.alias("doc_id"), "text")), "kept")
    rows = spool(known.groupBy(row.alias("_row")).agg(F.min(F.col("doc_id").cast("long")).alias("id"), F.count("*").alias("n")), "rows")
    groups = rows.join(found.select(F.col("doc_id").alias("_row"), "component_id").distinct(), "_row")
    kept = spool(groups.groupBy("component_id").agg(F.min(F.struct("id", "_row", "n")).alias("first")).select("first.*"), "kept-rows")
    once = docs.join(kept.select("_row"), row == F.col("_row"), "left_semi").where("doc_id is not null")
    if not kept.where("n > 1").isEmpty():
        once = once.dropDuplicates(["doc_id", "text"])
    return once.union(docs.where("doc_id is null"))


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights, with a row for each time a document is taken."""
    return mixed_documents(docs)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in a training sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Models, a similarity join and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
