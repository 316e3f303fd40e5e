"""DataFrame operators: pure functions from DataFrames and parameters to a DataFrame."""

from .calendar import business_calendar, period_bounds, period_bounds_of
from .comoments import correlation_of, correlation_state, merge_states
from .correlation import rolling_dd_correlation, system_correlation
from .daily import closed_pl_by_date, daily_close, of_systems, open_pl_by_date, table_counts
from .drawdown import (current_drawdown, drawdown_episodes, drawdown_episodes_by_segments, drawdown_vs_resample, sorted_episodes,
                       underwater, underwater_by_segments, worst_drawdowns)
from .portfolio import (benchmark_base, daily_equity, daily_equity_all_periods, daily_equity_vs_benchmark,
                        daily_equity_vs_benchmark_all_periods, monthly_returns, monthly_returns_all_periods,
                        monthly_returns_vs_benchmark, monthly_returns_vs_benchmark_all_periods)
from .resample import permutation_resample, resampled_episodes
from .systems import (allocations, daily_pct_change, system_daily_pl, system_equity_abs, system_equity_pct,
                      system_equity_wide, system_list, trade_blotter)

__all__ = [
    "business_calendar", "period_bounds", "period_bounds_of", "rolling_dd_correlation", "system_correlation",
    "closed_pl_by_date", "daily_close", "of_systems", "open_pl_by_date", "table_counts", "current_drawdown",
    "drawdown_episodes", "drawdown_vs_resample", "sorted_episodes", "underwater", "worst_drawdowns",
    "benchmark_base", "daily_equity", "daily_equity_all_periods", "daily_equity_vs_benchmark",
    "daily_equity_vs_benchmark_all_periods", "monthly_returns", "monthly_returns_all_periods",
    "monthly_returns_vs_benchmark", "monthly_returns_vs_benchmark_all_periods", "permutation_resample",
    "resampled_episodes", "correlation_of", "correlation_state", "merge_states", "drawdown_episodes_by_segments",
    "underwater_by_segments", "allocations", "daily_pct_change", "system_daily_pl", "system_equity_abs",
    "system_equity_pct", "system_equity_wide", "system_list", "trade_blotter",
]
