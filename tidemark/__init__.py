"""Portfolio analytics for trading systems, as PySpark DataFrame operators."""

from . import functions, operators, plans, sinks, sources
from .operators import *  # noqa: F403
from .sinks import export_csv, publish, read_published, write_table
from .sources import (backtest_systems, load_backtest, load_backtest_checked, load_bars, load_open_pl, load_trades,
                      load_trades_checked, on_days, read_by_month, read_query, read_table, spool, write_by_month)

__all__ = ["functions", "operators", "plans", "sinks", "sources", *operators.__all__, "export_csv", "publish",
           "read_published", "write_table", "backtest_systems", "load_backtest", "load_backtest_checked", "load_bars", "load_open_pl",
           "load_trades", "load_trades_checked", "on_days", "read_by_month", "read_query", "read_table", "spool", "write_by_month"]
