"""Input files, stored tables and shared intermediate tables."""

from .files import (Checked, backtest_systems, load_backtest, load_backtest_checked, load_bars, load_open_pl, load_trades,
                    load_trades_checked)
from .months import on_days, read_by_month, write_by_month
from .shared import fresh_path, shared_dir, spool
from .tables import read_query, read_table

__all__ = ["Checked", "backtest_systems", "load_backtest", "load_backtest_checked", "load_bars", "load_open_pl", "load_trades",
           "load_trades_checked", "on_days", "read_by_month", "write_by_month",
           "fresh_path", "shared_dir", "spool", "read_query", "read_table"]
