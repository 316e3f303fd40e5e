"""Numeric expressions. Division by zero gives NULL, never an error."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, WindowSpec, Window as W, functions as F


def in_range(date: Column, date_from: dt.date | Column, date_to: dt.date | Column) -> Column:
    """Half-open window ``(date_from, date_to]``."""
    lo = date_from if isinstance(date_from, Column) else F.lit(date_from)
    hi = date_to if isinstance(date_to, Column) else F.lit(date_to)
    return (date > lo) & (date <= hi)


def by_date() -> WindowSpec:
    """The rows of one system in date order."""
    return W.partitionBy("system").orderBy("date")


def running(window: WindowSpec) -> WindowSpec:
    """Frame from the first row to the current one."""
    return window.rowsBetween(W.unboundedPreceding, W.currentRow)


def rate_of(value: Column, base: Column) -> Column:
    """Distance of ``value`` from ``base`` in percent."""
    return (F.try_divide(value, base) - 1) * 100


def pct_change(value: Column, window: WindowSpec) -> Column:
    """Percent change from the previous row; NULL on the first one."""
    return rate_of(value, F.lag(value).over(window))


def compound_from(base: Column, change: Column, window: WindowSpec) -> Column:
    """``base`` grown by the running product of ``1 + change``."""
    return base * F.product(1 + change).over(running(window))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; NULL when either series is constant.

    The ``max > min`` test keeps rounding noise in a flat series from passing for variance.
    """
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def round_to(value: Column, places: int) -> Column:
    """Round a double half up to ``places`` decimals in primitive arithmetic.

    Beyond 2**52 a scaled double is a whole number already.
    """
    scale = float(10 ** places)
    scaled = value * scale
    return F.when(F.abs(scaled) < float(2 ** 52), F.floor(scaled + 0.5).cast("double")).otherwise(scaled) / scale
