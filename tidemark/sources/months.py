"""Stored tables with a folder per month, sorted by date inside: a range or a calendar reads only its months."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.stats import in_range

#: Folder column, a whole number such as 199907.
MONTH = "stored_month"


def month_number(date: Column) -> Column:
    return F.year(date) * 100 + F.month(date)


def write_by_month(df: DataFrame, path: str, date: str, if_exists: str = "errorifexists", rows_per_file: int = 5_000_000) -> None:
    """Store a table by the month of one of its dates.

    Rows are dealt out by ranges of (month, date, hash), so a busy month, or a busy day, is spread over several tasks and
    files, while a task writes few folders. Rows without the date have a folder of their own.
    """
    spread = F.xxhash64(*df.columns)
    rows = df.withColumn(MONTH, month_number(F.col(date))).repartitionByRange(MONTH, date, spread).sortWithinPartitions(MONTH, date)
    rows.write.mode(if_exists).option("maxRecordsPerFile", rows_per_file).partitionBy(MONTH).parquet(path)


def read_by_month(spark: SparkSession, path: str, date: str | None = None, date_from: dt.date | None = None,
                  date_to: dt.date | None = None) -> DataFrame:
    """A table written by ``write_by_month``, with its month; a range ``(date_from, date_to]`` picks folders, then row groups."""
    rows = spark.read.parquet(path)
    if date is None:
        return rows
    first, last = (d.year * 100 + d.month for d in (date_from, date_to))
    return rows.where(F.col(MONTH).between(first, last) & in_range(F.col(date), date_from, date_to))


def on_days(rows: DataFrame, date: str, days: DataFrame) -> DataFrame:
    """The rows of a monthly table that lie on one of ``days`` (a column ``date``).

    The months of the days take part in the join, so Spark reads only their folders (dynamic partition pruning).
    """
    wanted = days.select(F.col("date").alias("_day"), month_number(F.col("date")).alias("_month")).distinct()
    return rows.join(wanted, (F.col(MONTH) == F.col("_month")) & (F.col(date) == F.col("_day")), "left_semi")
