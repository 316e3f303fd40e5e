"""Business calendar and named periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import ALL_FLOOR, periods_array


def business_calendar(bars: DataFrame, floor: dt.date) -> DataFrame:
    """Trading days on or after ``floor``, one row each: date, month, year."""
    return (bars.where(F.col("date") >= F.lit(floor)).select("date").distinct()
            .withColumns({"month": F.month("date"), "year": F.year("date")}))


def period_bounds(spark: SparkSession, as_of: dt.date, all_floor: dt.date = ALL_FLOOR) -> DataFrame:
    """The named periods that end on one as-of date: period, date_from, date_to."""
    return period_bounds_of(spark.range(1).select(F.lit(as_of).alias("date")), all_floor)


def period_bounds_of(dates: DataFrame, all_floor: dt.date = ALL_FLOOR) -> DataFrame:
    """The named periods that end on each date of ``dates``."""
    return dates.select(F.inline(periods_array(F.col("date"), all_floor)), F.col("date").alias("date_to"))
