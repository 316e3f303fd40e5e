"""Running values over rows that need not meet in one task: by block first, then across blocks.

A block is a stretch of the order (months of a calendar, ranges of a step). Inside a block a window does the work; what came
before a block is a value per block, worked out from one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import running


def month_block(date: Column) -> Column:
    """Months since year 0."""
    return F.year(date) * 12 + F.month(date)


def year_block(ym: Column) -> Column:
    """The year of a ``yyyy-MM`` key."""
    return F.substring(ym, 1, 4).cast("int")


def running_total(rows: DataFrame, value: str, order: str, block: Column, last: Column, total: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the running sum of ``value``, per ``group``, NULL until the first value: as a window over the group would give.

    ``last`` is a block at or after that of every row. Each block's rows travel together with its total, and the total to
    every later block; so the rows are read once, a task holds some blocks, and no task holds all rows. Blocks are few: their
    number squared is what the totals cost.
    """
    keys = list(group)
    packed = rows.groupBy(*keys, block.alias("_block")).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])).alias("_rows"),
                                                            F.sum(value).alias("_total"))
    reach = packed.select(*keys, "_block", "_rows", "_total", F.explode(F.sequence("_block", last.cast("int"))).alias("_at"))
    sent = reach.select(*keys, "_at", F.when(F.col("_at") == F.col("_block"), F.col("_rows")).alias("_rows"),
                        F.when(F.col("_at") > F.col("_block"), F.col("_total")).alias("_total"))
    met = sent.groupBy(*keys, "_at").agg(F.sum("_total").alias("_before"), F.flatten(F.collect_list("_rows")).alias("_rows"))
    inside = F.sum(value).over(running(W.partitionBy(*keys, "_at").orderBy(order)))
    out = met.select(*keys, "_at", "_before", F.inline("_rows")).withColumn("_inside", inside)
    so_far = F.coalesce(F.col("_before") + F.col("_inside"), "_before", "_inside")
    return out.withColumn(total, so_far).select(*rows.columns, total)


def running_peak(rows: DataFrame, value: str, keys: list[str], order: str, segment: Column, peak: str) -> DataFrame:
    """``rows`` with the highest ``value`` so far of their curve (``keys``), each curve cut into segments of its order.

    A segment's summary is its peak; the running peak of all segments before it is carried in, so that one curve with most of
    the rows is spread over as many tasks as it has segments. Keys and order must not be NULL.
    """
    cut = rows.withColumn("_segment", segment)
    peaks = cut.groupBy(*keys, "_segment").agg(F.max(value).alias("_own"))
    before = W.partitionBy(*keys).orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)
    carried = peaks.select(*keys, "_segment", F.max("_own").over(before).alias("_before"))
    met = cut.join(carried, [*keys, "_segment"], "left")
    inside = F.max(value).over(running(W.partitionBy(*keys, "_segment").orderBy(order)))
    return met.withColumn(peak, F.greatest("_before", inside)).select(*rows.columns, peak)
