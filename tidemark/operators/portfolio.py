"""Portfolio curves: cumulative daily and monthly return, with or without a benchmark.

Everything here runs after the inputs were reduced to one row per calendar date, month or (period, date). Running
sums are taken in two levels (see ``prefix``), so no task holds the whole calendar; only the benchmark's bars, one
row per date, are put in one order for the close before each.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import ALL_FLOOR, PERIODS, month_key, period_start, periods_array
from ..functions.stats import in_range, rate_of
from .daily import closed_pl_by_date, daily_close, open_pl_by_date
from .prefix import month_block, running_total, year_block


def _days(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame,
          date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """Calendar days of the range with closed (NULL if none) and open (0 if none) totals.

    Both sides are aggregated and date-filtered before they meet the calendar.
    """
    return (calendar.where(in_range(F.col("date"), date_from, date_to)).select("date")
            .join(closed_pl_by_date(trades, date_from, date_to), "date", "left")
            .join(open_pl_by_date(open_pl, date_from, date_to), "date", "left")
            .withColumn("pl_open", F.coalesce("pl_open", F.lit(0))))


def _return_pct(profit: Column, capital: float) -> Column:
    equity = (F.lit(Decimal(str(capital))) + profit).cast("double")
    return rate_of(equity, F.lit(float(capital)))


def _cumulative(days: DataFrame, capital: float, date_to: dt.date, *group: str) -> DataFrame:
    """``days`` with p_ret_pct; the closed profit so far is summed month by month, then inside the month."""
    last = F.lit(date_to.year * 12 + date_to.month)
    out = running_total(days, "pl_closed", "date", month_block(F.col("date")), last, "closed_so_far", group)
    return out.withColumn("p_ret_pct", _return_pct(F.col("closed_so_far") + F.col("pl_open"), capital))


def daily_equity(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, capital: float,
                 date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """Cumulative portfolio return in percent per calendar day: date, p_ret_pct.

    The curve restarts at ``capital`` on ``date_from`` and is NULL until the first closed trade.
    Profit and loss on days outside the calendar does not count.
    """
    days = _days(calendar, trades, open_pl, date_from, date_to)
    return _cumulative(days, capital, date_to).select("date", "p_ret_pct")


def _numbered_closes(bars: DataFrame) -> DataFrame:
    """date, close, prev_close and the bar's number, over all stored bars: the one before may lie ahead of the chosen range."""
    order = W.orderBy("date")
    return daily_close(bars).select("date", "close", F.lag("close").over(order).alias("prev_close"), F.row_number().over(order).alias("bar_no"))


def _base() -> Column:
    """Aggregate: the close just before the first bar; the very first stored bar has none and leaves it to the next."""
    return F.min_by("prev_close", F.when(F.col("bar_no") > 1, F.col("date")))


def benchmark_base(bars: DataFrame, date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """One row: the close just before the first bar of the range (``base_close``).

    If the range starts at the very first stored bar, that bar's own close is the base.
    """
    return _numbered_closes(bars).where(in_range(F.col("date"), date_from, date_to)).agg(_base().alias("base_close"))


def _benchmark(bars: DataFrame, date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """Bars of the range with the base of the range, from one read of the bars: date, close, base_close."""
    chosen = _numbered_closes(bars).where(in_range(F.col("date"), date_from, date_to))
    return chosen.select("date", "close", _base().over(W.partitionBy()).alias("base_close"))


def _benchmark_by_period(bars: DataFrame, as_of: dt.date, all_floor: dt.date) -> DataFrame:
    """``_benchmark`` of each named period: period, date, close, base_close."""
    chosen = _by_period(_numbered_closes(bars).where(in_range(F.col("date"), _earliest(as_of, all_floor), as_of)), as_of, all_floor)
    return chosen.select("period", "date", "close", _base().over(W.partitionBy("period")).alias("base_close"))


def _bench_pct(name: str) -> Column:
    return rate_of(F.col("close").cast("double"), F.col("base_close").cast("double")).alias(name)


def daily_equity_vs_benchmark(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, bars: DataFrame,
                              capital: float, date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """``daily_equity`` next to the benchmark's return: date, p_ret_pct, bench_ret_pct."""
    days = _days(calendar, trades, open_pl, date_from, date_to).join(_benchmark(bars, date_from, date_to), "date", "left")
    return _cumulative(days, capital, date_to).select("date", "p_ret_pct", _bench_pct("bench_ret_pct"))


def _earliest(as_of: dt.date, all_floor: dt.date) -> Column:
    return F.least(*[period_start(F.lit(as_of), p, all_floor) for p in PERIODS])


def _by_period(rows: DataFrame, as_of: dt.date, all_floor: dt.date) -> DataFrame:
    """Repeat each dated row once per named period that covers it."""
    covering = F.filter(periods_array(F.lit(as_of), all_floor), lambda p: F.col("date") > p["date_from"])
    return rows.select("*", F.inline(covering)).drop("date_from")


def _period_days(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, as_of: dt.date, all_floor: dt.date) -> DataFrame:
    return _by_period(_days(calendar, trades, open_pl, _earliest(as_of, all_floor), as_of), as_of, all_floor)


def daily_equity_all_periods(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, capital: float,
                             as_of: dt.date, all_floor: dt.date = ALL_FLOOR) -> DataFrame:
    """``daily_equity`` for every named period in one job: period, date, p_ret_pct."""
    days = _period_days(calendar, trades, open_pl, as_of, all_floor)
    return _cumulative(days, capital, as_of, "period").select("period", "date", "p_ret_pct")


def daily_equity_vs_benchmark_all_periods(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame,
                                          bars: DataFrame, capital: float, as_of: dt.date,
                                          all_floor: dt.date = ALL_FLOOR) -> DataFrame:
    """``daily_equity_vs_benchmark`` for every named period: period, date, p_ret_pct, bench_ret_pct."""
    days = _period_days(calendar, trades, open_pl, as_of, all_floor)
    days = days.join(_benchmark_by_period(bars, as_of, all_floor), ["period", "date"], "left")
    return _cumulative(days, capital, as_of, "period").select("period", "date", "p_ret_pct", _bench_pct("bench_ret_pct"))


def _months(days: DataFrame, *extra: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """One row per month: closed total plus the open snapshot of the month's last calendar day."""
    total = F.sum("pl_closed") + F.max_by("pl_open", "date")
    return days.groupBy(*group, month_key(F.col("date")).alias("ym")).agg(total.alias("pl_total"), *extra)


def _cumulative_months(months: DataFrame, capital: float, date_to: dt.date, *group: str) -> DataFrame:
    """``months`` with cum_ret_p_pct; the totals so far are summed year by year, then inside the year."""
    out = running_total(months, "pl_total", "ym", year_block(F.col("ym")), F.lit(date_to.year), "total_so_far", group)
    return out.withColumn("cum_ret_p_pct", F.try_divide(F.col("total_so_far").cast("double"), F.lit(float(capital))) * 100)


def monthly_returns(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, capital: float,
                    date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """Cumulative monthly return in percent: ym, cum_ret_p_pct.

    Each month adds its closed total and its month-end open profit, so a position that stays open
    over several month ends counts in each of them. A month without a closed trade adds nothing,
    its open profit included; the sum carries forward.
    """
    months = _months(_days(calendar, trades, open_pl, date_from, date_to))
    return _cumulative_months(months, capital, date_to).select("ym", "cum_ret_p_pct")


def _with_closes() -> list[Column]:
    """Aggregates of a month: the close of its last calendar day, and the base of the range."""
    return [F.max_by("close", "date").alias("close"), F.max("base_close").alias("base_close")]


def monthly_returns_vs_benchmark(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, bars: DataFrame,
                                 capital: float, date_from: dt.date | Column, date_to: dt.date) -> DataFrame:
    """``monthly_returns`` next to the benchmark: ym, cum_ret_p_pct, cum_ret_bench_pct."""
    days = _days(calendar, trades, open_pl, date_from, date_to).join(_benchmark(bars, date_from, date_to), "date", "left")
    months = _months(days, *_with_closes())
    return _cumulative_months(months, capital, date_to).select("ym", "cum_ret_p_pct", _bench_pct("cum_ret_bench_pct"))


def monthly_returns_all_periods(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, capital: float,
                                as_of: dt.date, all_floor: dt.date = ALL_FLOOR) -> DataFrame:
    """``monthly_returns`` for every named period in one job: period, ym, cum_ret_p_pct."""
    months = _months(_period_days(calendar, trades, open_pl, as_of, all_floor), group=("period",))
    return _cumulative_months(months, capital, as_of, "period").select("period", "ym", "cum_ret_p_pct")


def monthly_returns_vs_benchmark_all_periods(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame,
                                             bars: DataFrame, capital: float, as_of: dt.date,
                                             all_floor: dt.date = ALL_FLOOR) -> DataFrame:
    """``monthly_returns_vs_benchmark`` for every named period."""
    days = _period_days(calendar, trades, open_pl, as_of, all_floor)
    days = days.join(_benchmark_by_period(bars, as_of, all_floor), ["period", "date"], "left")
    months = _months(days, *_with_closes(), group=("period",))
    return _cumulative_months(months, capital, as_of, "period").select("period", "ym", "cum_ret_p_pct", _bench_pct("cum_ret_bench_pct"))
