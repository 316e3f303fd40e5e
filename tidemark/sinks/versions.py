"""Tables that are rebuilt in whole or in part while they are read.

A write goes to a folder of its own, ``data/version=...``, with a folder per key inside. Only when it is complete does a row
in ``published`` name it, as the source of the whole table or of the keys that it replaces. A reader takes the rows in
``published`` first and then opens just the folders that are live by them. So it sees each key either as it was or as it
is, never half; a write that fails leaves the table as it was, and a folder that a reader has chosen is never touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_PUBLISHED = "number long, version string, keys array<string>"


def _published(spark: SparkSession, path: str) -> list[tuple[int, str, list[str] | None]]:
    """What was published, newest first: one small row per write."""
    try:
        rows = spark.read.schema(_PUBLISHED).parquet(f"{path}/published")
        return sorted(((r.number, r.version, r["keys"]) for r in rows.collect()), reverse=True)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":  # a table that nobody has written yet
            return []
        raise


def publish(df: DataFrame, path: str, key: str, only: Sequence[str] | None = None) -> str:
    """Store a table, or replace the rows of the keys in ``only``; returns the version.

    Rows of other keys are an error then. A key of ``only`` without rows disappears from the table.
    """
    spark = df.sparkSession
    before = _published(spark, path)
    if only is not None:
        if not before:
            raise ValueError(f"nothing to refresh in {path}")
        stray = F.raise_error(F.concat(F.lit(f"not to be refreshed: {key} "), F.col(key).cast("string"))).cast("boolean")
        df = df.where(F.when(F.col(key).cast("string").isin(list(only)), F.lit(True)).otherwise(stray))
    number = 1 + (before[0][0] if before else 0)
    version = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(key).parquet(f"{path}/data/version={version}")
    pointer = spark.createDataFrame([(number, version, None if only is None else list(only))], _PUBLISHED)
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return version


def live_versions(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """The version of the whole table, and the newer versions of single keys."""
    newer: dict[str, str] = {}
    for _, version, keys in _published(spark, path):
        if keys is None:
            return version, newer
        for k in keys:
            newer.setdefault(k, version)
    raise ValueError(f"no table in {path}")


def read_published(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table as last published, the key as text; a later write does not change what this DataFrame reads."""
    whole, newer = live_versions(spark, path)
    by_version: dict[str, list[str]] = {}
    for k, version in newer.items():
        by_version.setdefault(version, []).append(k)

    def folder(version: str, schema: T.StructType | None = None) -> DataFrame:
        reader = spark.read.option("basePath", f"{path}/data")
        return (reader.schema(schema) if schema else reader).parquet(f"{path}/data/version={version}")

    # folder names are text: a key such as 01 must not be read as a number
    found = folder(whole).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("version", key) else f for f in found])
    name, out = F.col(key), folder(whole, schema)
    if newer:
        out = out.where(~F.coalesce(name.isin(list(newer)), F.lit(False)))
    for version, keys in by_version.items():
        out = out.unionByName(folder(version, schema).where(name.isin(keys)))
    return out.drop("version")
