"""Column expressions shared by the operators."""

from .dates import PERIODS, month_end, month_key, parse_day_first, period_start, periods_array, range_start
from .stats import by_date, compound_from, in_range, pct_change, rate_of, round_to, running, safe_corr
from .text import clean_name, format_2dp, trunc_2dp

__all__ = [
    "PERIODS", "month_end", "month_key", "parse_day_first", "period_start", "periods_array", "range_start",
    "by_date", "compound_from", "in_range", "pct_change", "rate_of", "round_to", "running", "safe_corr",
    "clean_name", "format_2dp", "trunc_2dp",
]
