"""The three reports, as named DataFrames.

A range starts on a date or is a named period ("ytd", "3_months", ...) that ends on ``date_to``. Building the system and the
risk report runs a job that stores the daily totals; the named results are worked out when they are used.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import ALL_FLOOR, range_start
from ..functions.text import trunc_2dp
from ..operators import (current_drawdown, daily_equity, daily_equity_vs_benchmark, drawdown_vs_resample,
                         monthly_returns, monthly_returns_vs_benchmark, of_systems, rolling_dd_correlation, sorted_episodes,
                         system_correlation, system_daily_pl, system_equity_abs, system_equity_pct, trade_blotter, underwater,
                         worst_drawdowns)
from ..sources import spool


def portfolio_report(calendar: DataFrame, trades: DataFrame, open_pl: DataFrame, capital: float,
                     date_from: dt.date | str, date_to: dt.date, bars: DataFrame | None = None,
                     all_floor: dt.date = ALL_FLOOR) -> dict[str, DataFrame]:
    """``equity`` and ``monthly``; compared with the benchmark if ``bars`` are given."""
    date_from = range_start(date_from, date_to, all_floor)
    if bars is None:
        args = (calendar, trades, open_pl, capital, date_from, date_to)
        return {"equity": daily_equity(*args), "monthly": monthly_returns(*args)}
    args = (calendar, trades, open_pl, bars, capital, date_from, date_to)
    return {"equity": daily_equity_vs_benchmark(*args), "monthly": monthly_returns_vs_benchmark(*args)}


def stored_system_equity(trades: DataFrame, open_pl: DataFrame, alloc: DataFrame, capital: float,
                         date_from: dt.date, date_to: dt.date, systems: Iterable[str] | None = None) -> DataFrame:
    """System equity over daily totals that were stored first.

    The curve needs its totals several times (date axis, first and last day, the rows themselves).
    Trades and open positions are read once, reduced to one row per date and system and stored;
    all else works on that small table.
    """
    pl = spool(system_daily_pl(trades, open_pl, date_from, date_to, systems), "system-daily-pl")
    return system_equity_abs(pl, alloc, capital)


def system_report(trades: DataFrame, open_pl: DataFrame, alloc: DataFrame, capital: float, date_from: dt.date | str,
                  date_to: dt.date, systems: Iterable[str] | None = None, all_floor: dt.date = ALL_FLOOR) -> dict[str, DataFrame]:
    """``equity_pct``, ``correlation`` and ``trades`` of the chosen systems."""
    date_from = range_start(date_from, date_to, all_floor)
    systems = None if systems is None else list(systems)
    equity = stored_system_equity(trades, open_pl, alloc, capital, date_from, date_to, systems)
    return {"equity_pct": system_equity_pct(equity), "correlation": system_correlation(equity),
            "trades": trade_blotter(trades, date_from, systems)}


def key_metrics(current: DataFrame) -> DataFrame:
    """Current drawdown per system for display: system, dd_size (cut to two decimals), dd_days."""
    return current.select("system", trunc_2dp(F.col("dd_pct")).alias("dd_size"), "dd_days")


def risk_report(trades: DataFrame, open_pl: DataFrame, episodes: DataFrame, alloc: DataFrame, capital: float,
                date_from: dt.date | str, date_to: dt.date, metric: str = "pct", worst: int = 10, lookback: int = 60,
                inactive: Iterable[str] = (), systems: Iterable[str] | None = None, chosen: str | None = None,
                all_floor: dt.date = ALL_FLOOR) -> dict[str, DataFrame]:
    """``key_metrics``, ``underwater``, ``rolling_correlation``, ``distribution`` and ``points``.

    The rolling correlation is over all systems; ``systems`` picks the curves of ``underwater``. ``chosen`` picks the one
    system of the key metrics and the distribution, whose single drawdowns, worst first by the metric, are ``points``; without it
    all systems are given.
    """
    date_from, one = range_start(date_from, date_to, all_floor), None if chosen is None else [chosen]
    dd = underwater(stored_system_equity(trades, open_pl, alloc, capital, date_from, date_to))
    current, mine = of_systems(current_drawdown(dd), one), of_systems(episodes, one)
    return {"key_metrics": key_metrics(current), "underwater": of_systems(dd, systems),
            "rolling_correlation": rolling_dd_correlation(dd, lookback, inactive),
            "distribution": drawdown_vs_resample(current, worst_drawdowns(mine, metric, worst), metric),
            "points": sorted_episodes(mine, metric)}
