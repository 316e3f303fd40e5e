"""Stored tables and parameterised SQL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .files import typed


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``sinks.write_table``."""
    return spark.read.parquet(path)


def read_query(spark: SparkSession, sql: str, params: Mapping[str, Any] | list | None = None,
               date_cols: Iterable[str] = (), on_bad: str = "raise", **tables: DataFrame) -> DataFrame:
    """Run SQL with bound parameters; ``{name}`` in the text stands for a table passed by name.

    Columns named in ``date_cols`` are turned into dates, text being read day first. Blank text is NULL; other text that
    is no date is an error, or NULL with ``on_bad="null"``.
    """
    out = spark.sql(sql, args=params, **tables)
    text = {f.name for f in out.schema if f.dataType.typeName() == "string"}
    return out.withColumns({c: typed(F.col(c), T.DateType(), on_bad) if c in text else F.to_date(c) for c in date_cols})
