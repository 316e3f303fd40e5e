"""Per-system curves: daily profit and loss, equity, percent curves, blotter."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .. import schemas
from ..functions.stats import by_date, in_range, pct_change, rate_of, running
from .daily import of_systems


def system_list(rows: DataFrame) -> DataFrame:
    """Distinct systems that occur in a table."""
    return rows.select("system").distinct()


def allocations(spark: SparkSession, shares: Mapping[str, float]) -> DataFrame:
    """The allocation map as a small table: system, alloc. Shares need not add up to 1."""
    table = pa.table({"system": list(shares), "alloc": [float(a) for a in shares.values()]})
    return spark.createDataFrame(table, schemas.ALLOCATIONS)


def system_daily_pl(trades: DataFrame, open_pl: DataFrame, date_from: dt.date, date_to: dt.date,
                    systems: Iterable[str] | None = None) -> DataFrame:
    """Closed and open totals per date and system: date, system, pl_closed, pl_open.

    Dates need not be in the calendar. ``systems=None`` takes every system found in ``trades``, also when
    filtering open positions. Only trades of the range are summed; whether a system was traded at all is read
    from one column and met by the sums of the open positions, not by their rows.
    """
    wanted = in_range(F.col("date"), date_from, date_to)
    nothing = F.lit(None).cast(schemas.MONEY)
    closed = (of_systems(trades, systems).select(F.col("exit_date").alias("date"), "system", "pl").where(wanted)
              .groupBy("date", "system").agg(F.sum("pl").alias("pl_closed")).withColumn("pl_open", nothing))
    opened = (of_systems(open_pl, systems).where(wanted).groupBy("date", "system").agg(F.sum("pl").alias("pl_open"))
              .withColumn("pl_closed", nothing))
    if systems is None:
        opened = opened.join(of_systems(trades, None).select("system").distinct(), "system", "left_semi")
    totals = closed.unionByName(opened).groupBy("date", "system").agg(F.sum("pl_closed").alias("pl_closed"), F.sum("pl_open").alias("pl_open"))
    return totals.select("date", "system", F.coalesce("pl_closed", F.lit(0)).alias("pl_closed"),
                         F.coalesce("pl_open", F.lit(0)).alias("pl_open"))


def _dense(pl: DataFrame) -> DataFrame:
    """Carry each system over every date of the shared axis: date, system, closed so far, open.

    Each stored row stands for the stretch of days up to the system's next row and is spread over
    it; a semi join keeps the days on which any system has a row. No system x date product is built.
    """
    axis = pl.select("date").distinct()
    ends = pl.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last")).alias("ends")).scalar()
    stretches = pl.select(
        "system", "pl_open", F.col("date").alias("row_date"),
        F.sum("pl_closed").over(running(by_date())).alias("closed"),
        F.when(F.row_number().over(by_date()) == 1, ends["first"]).otherwise(F.col("date")).alias("first_day"),
        F.coalesce(F.date_sub(F.lead("date").over(by_date()), 1), ends["last"]).alias("last_day"))
    days = stretches.select("*", F.explode(F.sequence("first_day", "last_day")).alias("date"))
    return days.join(axis, "date", "left_semi").select(
        "date", "system",
        F.when(F.col("date") >= F.col("row_date"), F.col("closed")).otherwise(F.lit(0)).alias("closed"),
        F.when(F.col("date") == F.col("row_date"), F.col("pl_open")).otherwise(F.lit(0)).alias("pl_open"))


def system_equity_abs(pl: DataFrame, alloc: DataFrame, capital: float) -> DataFrame:
    """Equity per date and system on one shared date axis: date, system, equity.

    Running closed profit plus that day's open profit (0 if none) plus the system's share of the
    capital. A traded system without an allocation is an error. ``pl`` is read more than once;
    on large inputs pass a stored table (see ``sources.spool``).
    """
    share = F.col("alloc").cast("decimal(18,8)") * F.lit(Decimal(str(capital)))
    start = F.when(F.col("alloc").isNull(),
                   F.raise_error(F.concat(F.lit("no allocation for system "), F.col("system")))).otherwise(share)
    equity = (F.col("closed") + F.col("pl_open") + start).cast("double")
    return _dense(pl).join(alloc, "system", "left").select("date", "system", equity.alias("equity"))


def system_equity_pct(equity_abs: DataFrame) -> DataFrame:
    """Compounded return in percent since each system's first date: date, system, ret_pct.

    Compounding daily changes telescopes to ``equity / first equity - 1``.
    """
    first = F.first("equity").over(running(by_date()))
    return equity_abs.select("date", "system", rate_of(F.col("equity"), first).alias("ret_pct"))


def system_equity_wide(equity: DataFrame, systems: Iterable[str], value: str = "equity") -> DataFrame:
    """One column per system, one row per date; for output only."""
    return equity.groupBy("date").pivot("system", list(systems)).agg(F.sum(value))


def daily_pct_change(series: DataFrame, value: str = "equity") -> DataFrame:
    """Change from the previous row in percent: date, system, pct_change (NULL on the first row)."""
    return series.select("date", "system", pct_change(F.col(value), by_date()).alias("pct_change"))


def trade_blotter(trades: DataFrame, entered_after: dt.date, systems: Iterable[str] | None = None) -> DataFrame:
    """Trades entered after a date, newest id first. No upper bound; still open trades included.

    The other columns break ties, which also lets the range sort split an id that occurs very often.
    """
    ties = [c for c in trades.columns if c != "trade_id"]
    return (of_systems(trades, systems).where(F.col("entry_date") > F.lit(entered_after))
            .orderBy(F.desc("trade_id"), *ties))
