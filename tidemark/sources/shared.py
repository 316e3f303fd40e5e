"""The folder that all executors can reach, and intermediate tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; a scratch folder only for a local session without one."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write a result that several consumers share once, and read it back.

    Ends the lineage in stored files, so neither a lost executor nor a second consumer repeats the
    work, and gives the planner the true size for its join choices.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
