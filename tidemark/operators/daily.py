"""Daily totals of closed and open profit and loss."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import in_range


def closed_pl_by_date(trades: DataFrame, date_from: dt.date | Column | None = None,
                      date_to: dt.date | None = None) -> DataFrame:
    """date, pl_closed. Trades without an exit date are not closed and drop out."""
    rows = trades.where(F.col("exit_date").isNotNull())
    if date_from is not None:
        rows = rows.where(in_range(F.col("exit_date"), date_from, date_to))
    return rows.groupBy(F.col("exit_date").alias("date")).agg(F.sum("pl").alias("pl_closed"))


def open_pl_by_date(open_pl: DataFrame, date_from: dt.date | Column | None = None,
                    date_to: dt.date | None = None) -> DataFrame:
    """date, pl_open."""
    rows = open_pl.where(F.col("date").isNotNull())
    if date_from is not None:
        rows = rows.where(in_range(F.col("date"), date_from, date_to))
    return rows.groupBy("date").agg(F.sum("pl").alias("pl_open"))


def daily_close(bars: DataFrame) -> DataFrame:
    """date, close, one row per date."""
    return bars.groupBy("date").agg(F.max("close").alias("close"))


def of_systems(rows: DataFrame, systems: Iterable[str] | None) -> DataFrame:
    """Rows of the chosen systems; an empty choice gives no rows, None gives every named one."""
    if systems is None:
        return rows.where(F.col("system").isNotNull())
    return rows.where(F.col("system").isin(list(systems)))


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count of each table: table_name, row_count."""
    counts = [t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
