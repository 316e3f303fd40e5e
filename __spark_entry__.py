
from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import tidemark as tm
from oracle_queries import ORACLES
from tidemark import fixtures as fx
from tidemark.functions import format_2dp
from tidemark.plans import (key_metrics, portfolio_report, prepare, publish_episodes, risk_report, stored_system_equity,
                            system_report)
from tidemark.sources import fresh_path

try:
    from tidemark.llm.queries import ORACLES as LLM_ORACLES, QUERIES as LLM_QUERIES
    import corpus_pipeline
    LLM_QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL:
        LLM_ORACLES = {**LLM_ORACLES, "pipeline": corpus_pipeline.ORACLE_SQL}
except ModuleNotFoundError as missing:  # the subpackage is optional; a library that it lacks is an error
    if missing.name not in ("tidemark.llm", "corpus_pipeline"):
        raise
    LLM_QUERIES, LLM_ORACLES = {}, {}

CAPITAL = 1_000_000
FLOOR = dt.date(1995, 1, 1)
ALL_FROM = dt.date(1994, 12, 31)
AS_OF = dt.date(2000, 12, 31)
YTD_FROM = dt.date(1999, 12, 31)
SELECTED = ["1-URGENT", "3-MEDIUM"]
RUNS, SEED, LOOKBACK, WORST = 100, 42, 60, 10

RANGE = (ALL_FROM, AS_OF)


def _rounded(df: DataFrame, *cols: str, places: int = 8) -> DataFrame:
    """Round result columns, so that two engines agree on the last digits.

    Returns on round capital end after eight decimals; rounding to fewer would meet exact halves.
    """
    return df.withColumns({c: F.round(c, places) for c in cols})


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calendar, trades, open positions."""
    return tm.business_calendar(fx.bars(spark, sf), FLOOR), fx.trades(spark, sf), fx.open_pl(spark, sf)


def _alloc(spark: SparkSession) -> DataFrame:
    return tm.allocations(spark, {s: 0.2 for s in fx.SYSTEMS})


def _equity(spark: SparkSession, sf: str, systems: list[str] | None = None) -> DataFrame:
    return stored_system_equity(fx.trades(spark, sf), fx.open_pl(spark, sf), _alloc(spark), CAPITAL, *RANGE, systems)


def _underwater(spark: SparkSession, sf: str) -> DataFrame:
    return tm.underwater(_equity(spark, sf))


def _episodes(spark: SparkSession, sf: str, merge: bool = False) -> DataFrame:
    return tm.resampled_episodes(fx.backtest(spark, sf), RUNS, SEED, merge)


# Calendar and daily totals

def business_calendar(spark, sf):
    return tm.business_calendar(fx.bars(spark, sf), FLOOR)


def period_bounds(spark, sf):
    return tm.period_bounds_of(business_calendar(spark, sf), ALL_FROM)


def daily_closed_pl(spark, sf):
    return tm.closed_pl_by_date(fx.trades(spark, sf))


def daily_open_pl(spark, sf):
    return tm.open_pl_by_date(fx.open_pl(spark, sf))


def table_counts(spark, sf):
    return tm.table_counts(trades=fx.trades(spark, sf), open_pl=fx.open_pl(spark, sf), bars=fx.bars(spark, sf),
                           backtest=fx.backtest(spark, sf))


# Portfolio

def daily_equity(spark, sf):
    return _rounded(tm.daily_equity(*_inputs(spark, sf), CAPITAL, *RANGE), "p_ret_pct")


def daily_equity_ytd(spark, sf):
    return _rounded(tm.daily_equity(*_inputs(spark, sf), CAPITAL, YTD_FROM, AS_OF), "p_ret_pct")


def daily_equity_all_periods(spark, sf):
    return _rounded(tm.daily_equity_all_periods(*_inputs(spark, sf), CAPITAL, AS_OF, ALL_FROM), "p_ret_pct")


def benchmark_base(spark, sf):
    return tm.benchmark_base(fx.bars(spark, sf), YTD_FROM, AS_OF)


def daily_equity_vs_benchmark(spark, sf):
    out = tm.daily_equity_vs_benchmark(*_inputs(spark, sf), fx.bars(spark, sf), CAPITAL, *RANGE)
    return _rounded(out, "p_ret_pct", "bench_ret_pct")


def daily_equity_vs_benchmark_all_periods(spark, sf):
    out = tm.daily_equity_vs_benchmark_all_periods(*_inputs(spark, sf), fx.bars(spark, sf), CAPITAL, AS_OF, ALL_FROM)
    return _rounded(out, "p_ret_pct", "bench_ret_pct")


def monthly_returns(spark, sf):
    return _rounded(tm.monthly_returns(*_inputs(spark, sf), CAPITAL, *RANGE), "cum_ret_p_pct")


def monthly_returns_vs_benchmark(spark, sf):
    out = tm.monthly_returns_vs_benchmark(*_inputs(spark, sf), fx.bars(spark, sf), CAPITAL, *RANGE)
    return _rounded(out, "cum_ret_p_pct", "cum_ret_bench_pct")


def monthly_returns_all_periods(spark, sf):
    return _rounded(tm.monthly_returns_all_periods(*_inputs(spark, sf), CAPITAL, AS_OF, ALL_FROM), "cum_ret_p_pct")


def monthly_returns_vs_benchmark_all_periods(spark, sf):
    out = tm.monthly_returns_vs_benchmark_all_periods(*_inputs(spark, sf), fx.bars(spark, sf), CAPITAL, AS_OF, ALL_FROM)
    return _rounded(out, "cum_ret_p_pct", "cum_ret_bench_pct")


def monthly_table(spark, sf):
    return monthly_returns(spark, sf).select("ym", format_2dp(F.col("cum_ret_p_pct")).alias("cum_ret_p_pct"))


# Systems

def system_list(spark, sf):
    return tm.system_list(fx.trades(spark, sf))


def system_daily_pl(spark, sf):
    return tm.system_daily_pl(fx.trades(spark, sf), fx.open_pl(spark, sf), *RANGE)


def system_daily_pl_selected(spark, sf):
    return tm.system_daily_pl(fx.trades(spark, sf), fx.open_pl(spark, sf), *RANGE, SELECTED)


def system_equity_abs(spark, sf):
    return _rounded(_equity(spark, sf), "equity")


def system_equity_abs_selected(spark, sf):
    return _rounded(_equity(spark, sf, SELECTED), "equity")


def system_equity_pct(spark, sf):
    return _rounded(tm.system_equity_pct(_equity(spark, sf)), "ret_pct")


def system_equity_wide(spark, sf):
    return _rounded(tm.system_equity_wide(_equity(spark, sf), fx.SYSTEMS), *fx.SYSTEMS)


def system_correlation(spark, sf):
    return _rounded(tm.system_correlation(_equity(spark, sf)), "corr", places=6)


def system_correlation_uneven(spark, sf):
    return _rounded(tm.system_correlation(fx.backtest(spark, sf)), "corr", places=6)


def trade_blotter(spark, sf):
    return tm.trade_blotter(fx.trades(spark, sf), YTD_FROM)


def trade_blotter_selected(spark, sf):
    return tm.trade_blotter(fx.trades(spark, sf), ALL_FROM, SELECTED)


def daily_pct_change(spark, sf):
    return _rounded(tm.daily_pct_change(fx.backtest(spark, sf)), "pct_change")


# Drawdowns

def underwater(spark, sf):
    return _rounded(_underwater(spark, sf), "dd_pct")


def underwater_selected(spark, sf):
    return tm.of_systems(underwater(spark, sf), SELECTED)


def current_drawdown(spark, sf):
    return _rounded(tm.current_drawdown(_underwater(spark, sf)), "dd_pct")


def risk_key_metrics(spark, sf):
    return key_metrics(current_drawdown(spark, sf))


def rolling_dd_correlation(spark, sf):
    return _rounded(tm.rolling_dd_correlation(_underwater(spark, sf), LOOKBACK), "combined_corr", places=4)


def rolling_dd_correlation_active(spark, sf):
    out = tm.rolling_dd_correlation(_underwater(spark, sf), LOOKBACK, inactive=["2-HIGH", "not traded"])
    return _rounded(out, "combined_corr", places=4)


# Resampling

def backtest_systems(spark, sf):
    return tm.backtest_systems(fx.backtest(spark, sf))


def permutation_resample(spark, sf):
    return tm.permutation_resample(fx.backtest(spark, sf), RUNS, SEED)


def drawdown_episodes(spark, sf):
    return _rounded(_episodes(spark, sf), "pct")


def drawdown_episodes_merged(spark, sf):
    return _rounded(_episodes(spark, sf, merge=True), "pct")


def drawdown_episodes_by_depth(spark, sf):
    return _rounded(tm.sorted_episodes(_episodes(spark, sf), "pct"), "pct")


def worst_drawdowns_pct(spark, sf):
    return _rounded(tm.worst_drawdowns(_episodes(spark, sf), "pct", WORST), "worst_1", "worst_n")


def worst_drawdowns_days(spark, sf):
    return tm.worst_drawdowns(_episodes(spark, sf), "days", WORST)


def _distribution(spark, sf, metric):
    worst = tm.worst_drawdowns(_episodes(spark, sf), metric, WORST)
    out = tm.drawdown_vs_resample(tm.current_drawdown(_underwater(spark, sf)), worst, metric)
    return _rounded(out, "current", "worst_n", "worst_1")


def drawdown_vs_resample(spark, sf):
    return _distribution(spark, sf, "pct")


def drawdown_vs_resample_days(spark, sf):
    return _distribution(spark, sf, "days")


# Files and stored tables: written in the layout of the inputs, then read by the loaders

def load_trades(spark, sf):
    path = fresh_path(spark, "trades-csv")
    fx.write_trades_csv(fx.trades(spark, sf), path)
    return tm.load_trades(spark, path)


def load_bars(spark, sf):
    path = fresh_path(spark, "bars-csv")
    fx.write_bars_csv(fx.bars(spark, sf), path)
    return tm.load_bars(spark, path)


def backtest_unpivot(spark, sf):
    path = fresh_path(spark, "backtest-csv")
    fx.write_backtest_csv(fx.backtest(spark, sf), path)
    return tm.load_backtest(spark, path)


def open_pl_from_wide(spark, sf):
    path = fresh_path(spark, "open-pl-wide")
    fx.write_open_pl_wide(fx.open_positions_with_id(spark, sf), path)
    return tm.load_open_pl(spark, path)


def csv_export_roundtrip(spark, sf):
    path = fresh_path(spark, "monthly-csv")
    tm.export_csv(monthly_returns(spark, sf), path)
    return spark.read.schema("ym string, cum_ret_p_pct double").option("header", True).csv(path)


def table_roundtrip(spark, sf):
    path = fresh_path(spark, "daily-open")
    half = F.col("date") <= F.lit(dt.date(1998, 12, 31))
    daily = daily_open_pl(spark, sf)
    tm.write_table(daily.where(half), path, "fail", dtypes={"pl_open": "decimal(38,4)"})
    tm.write_table(daily.where(~half), path, "append", dtypes={"pl_open": "decimal(38,4)"})
    return tm.read_table(spark, path)


def load_trades_accepted(spark, sf):
    return _spoilt_trades(spark, sf).accepted


def load_trades_rejected(spark, sf):
    cell = lambda name: F.element_at("cells", name)
    return _spoilt_trades(spark, sf).rejected.select(
        cell("trade_id").cast("bigint").alias("trade_id"), F.concat_ws(",", "bad").alias("bad"), cell("exit_date").alias("exit_date"), cell("pl").alias("pl"))


def load_trades_counts(spark, sf):
    counts = _spoilt_trades(spark, sf).counts
    return spark.range(1).select(*[F.lit(counts[n]).cast("bigint").alias(n) for n in ("rows", "rejected", "bad_exit_date", "bad_pl", "bad_entry_date")])


def _spoilt_trades(spark, sf):
    path = fresh_path(spark, "spoilt-trades")
    fx.write_trades_csv(fx.trades(spark, sf), path, spoilt=True)
    return tm.load_trades_checked(spark, path)


def load_backtest_rejected(spark, sf):
    path = fresh_path(spark, "spoilt-backtest")
    fx.write_backtest_csv(fx.backtest(spark, sf), path, spoilt=True)
    found = tm.load_backtest_checked(spark, path)
    kept = found.accepted.groupBy("system").agg(F.count(F.lit(1)).alias("accepted"))
    bad = found.rejected.groupBy(F.element_at("cells", "system").alias("system")).agg(F.count(F.lit(1)).alias("rejected"))
    total = F.lit(found.counts["bad_equity"]).cast("bigint").alias("rejected_in_all")
    return kept.join(bad, "system", "left").select("system", "accepted", "rejected", total)


def backtest_mixed_headers(spark, sf):
    path, rows = fresh_path(spark, "mixed-backtest"), fx.backtest(spark, sf)
    early = F.col("date") <= F.lit(dt.date(1996, 12, 31))
    fx.write_backtest_csv(rows.where(early), f"{path}/early")
    fx.write_backtest_csv(rows.where(~early), f"{path}/late", fx.SYSTEMS[::-1][:3])
    return tm.load_backtest(spark, [f"{path}/early", f"{path}/late"])


def load_bars_with_blanks(spark, sf):
    path = fresh_path(spark, "blank-bars")
    fx.write_bars_csv(fx.bars(spark, sf), path, blanks=True)
    return tm.load_bars(spark, path)


# Stored tables: refreshed in part, laid out by month

def episodes_refreshed_system(spark, sf):
    path, backtest = fresh_path(spark, "episodes"), fx.backtest(spark, sf)
    publish_episodes(backtest, path, RUNS, SEED)
    publish_episodes(backtest, path, RUNS, SEED + 1, systems=["2-HIGH"])
    return _rounded(tm.read_published(spark, path, "system"), "pct").select("system", "run", "equity_high", "pct", "days")


def episodes_replaced_folder(spark, sf):
    path, backtest = fresh_path(spark, "episode-folders"), fx.backtest(spark, sf)
    tm.write_table(tm.resampled_episodes(backtest, RUNS, SEED), path, partition_by=["system"])
    again = tm.resampled_episodes(tm.of_systems(backtest, ["2-HIGH"]), RUNS, SEED + 1)
    tm.write_table(again, path, "replace_parts", partition_by=["system"])
    return _rounded(tm.read_table(spark, path), "pct").select("system", "run", "equity_high", "pct", "days")


def table_rebuilt(spark, sf):
    path, totals = fresh_path(spark, "rebuilt"), daily_closed_pl(spark, sf)
    tm.write_table(totals.where("date <= date'1996-12-31'"), path)
    tm.write_table(totals, path, "replace")
    return tm.read_table(spark, path)


def _trades_by_month(spark, sf):
    path = fresh_path(spark, "trades-by-month")
    tm.write_by_month(fx.trades(spark, sf), path, "exit_date")
    return path


def closed_pl_of_stored_range(spark, sf):
    rows = tm.read_by_month(spark, _trades_by_month(spark, sf), "exit_date", dt.date(1996, 2, 14), dt.date(1997, 8, 20))
    return tm.closed_pl_by_date(rows)


def closed_pl_of_stored_days(spark, sf):
    rows = tm.read_by_month(spark, _trades_by_month(spark, sf))
    marches = business_calendar(spark, sf).where("month = 3")
    return tm.closed_pl_by_date(tm.on_days(rows, "exit_date", marches))


def read_query_text_dates(spark, sf):
    text = "select distinct date_format(exit_date, 'd.M.yy') as day from {trades} where exit_date >= :since"
    return tm.read_query(spark, text, {"since": dt.date(2000, 1, 1)}, date_cols=["day"], trades=fx.trades(spark, sf))


# The whole flow

def prepare_counts(spark, sf):
    base, inputs = fresh_path(spark, "prepare"), {}
    writers = {"trades": (fx.write_trades_csv, fx.trades), "bars": (fx.write_bars_csv, fx.bars), "backtest": (fx.write_backtest_csv, fx.backtest),
               "open_pl": (fx.write_open_pl_wide, fx.open_positions_with_id)}
    for name, (write, rows) in writers.items():
        inputs[name] = f"{base}/in/{name}"
        write(rows(spark, sf), inputs[name])
    for _ in range(2):
        stored = prepare(spark, inputs, f"{base}/out", FLOOR, runs=10, seed=SEED)
    return tm.table_counts(**{n: stored[n] for n in ("bars", "open_pl", "trades", "backtest", "curves", "calendar")})


def report_portfolio_ytd(spark, sf):
    page = portfolio_report(*_inputs(spark, sf), CAPITAL, "ytd", AS_OF, bars=fx.bars(spark, sf))
    return _rounded(page["equity"], "p_ret_pct", "bench_ret_pct")


def report_system_selected(spark, sf):
    page = system_report(fx.trades(spark, sf), fx.open_pl(spark, sf), _alloc(spark), CAPITAL, "all", AS_OF, SELECTED, all_floor=ALL_FROM)
    return _rounded(page["equity_pct"], "ret_pct")


def _risk_page(spark, sf, **more):
    return risk_report(fx.trades(spark, sf), fx.open_pl(spark, sf), _episodes(spark, sf), _alloc(spark), CAPITAL, "all", AS_OF, "days", WORST,
                       LOOKBACK, all_floor=ALL_FROM, **more)


def report_risk_points(spark, sf):
    return _rounded(_risk_page(spark, sf, chosen="3-MEDIUM")["points"], "pct")


def report_risk_underwater(spark, sf):
    return _rounded(_risk_page(spark, sf, systems=SELECTED)["underwater"], "dd_pct")


def report_risk_distribution(spark, sf):
    return _rounded(_risk_page(spark, sf, chosen="3-MEDIUM")["distribution"], "current", "worst_n", "worst_1")


# Curves and matrices in parts

def drawdown_episodes_segmented(spark, sf):
    curves = tm.permutation_resample(fx.backtest(spark, sf), RUNS, SEED)
    return _rounded(tm.drawdown_episodes_by_segments(curves, 400), "pct")


def underwater_segmented(spark, sf):
    return _rounded(tm.underwater_by_segments(_equity(spark, sf), 365), "dd_pct")


def system_correlation_appended(spark, sf):
    path, equity = fresh_path(spark, "correlation-state"), _equity(spark, sf)
    parts = ("date <= date'1997-03-31'", "date > date'1997-03-31' and date <= date'1999-12-31'", "date > date'1999-12-31'")
    for where in parts:
        tm.write_table(tm.correlation_state(equity.where(where)), path, "append")
    return _rounded(tm.correlation_of(tm.merge_states(tm.read_table(spark, path))), "corr", places=6)


def sql_with_parameters(spark, sf):
    text = """select system, date_format(exit_date, 'dd/MM/yyyy') as exit_date, sum(pl) as pl
              from {trades} where exit_date > :date_from and exit_date <= :date_to group by system, exit_date"""
    return tm.read_query(spark, text, {"date_from": YTD_FROM, "date_to": AS_OF}, date_cols=["exit_date"],
                         trades=fx.trades(spark, sf))


_QUERIES = (
    business_calendar, period_bounds, daily_closed_pl, daily_open_pl, table_counts,
    daily_equity, daily_equity_ytd, daily_equity_all_periods, benchmark_base, daily_equity_vs_benchmark,
    daily_equity_vs_benchmark_all_periods, monthly_returns, monthly_returns_vs_benchmark,
    monthly_returns_all_periods, monthly_returns_vs_benchmark_all_periods, monthly_table,
    system_list, system_daily_pl, system_daily_pl_selected, system_equity_abs, system_equity_abs_selected,
    system_equity_pct, system_equity_wide, system_correlation, system_correlation_uneven, trade_blotter, trade_blotter_selected,
    daily_pct_change, underwater, underwater_selected, current_drawdown, risk_key_metrics, rolling_dd_correlation,
    rolling_dd_correlation_active, backtest_systems, permutation_resample, drawdown_episodes,
    drawdown_episodes_merged, drawdown_episodes_by_depth, worst_drawdowns_pct, worst_drawdowns_days,
    drawdown_vs_resample, drawdown_vs_resample_days, load_trades, load_bars, backtest_unpivot,
    open_pl_from_wide, csv_export_roundtrip, table_roundtrip, sql_with_parameters, load_trades_accepted, load_trades_rejected,
    load_trades_counts, load_backtest_rejected, backtest_mixed_headers, load_bars_with_blanks, episodes_refreshed_system,
    episodes_replaced_folder, table_rebuilt, closed_pl_of_stored_range, closed_pl_of_stored_days, read_query_text_dates,
    prepare_counts, report_portfolio_ytd, report_system_selected, report_risk_points, report_risk_underwater, report_risk_distribution,
    drawdown_episodes_segmented, underwater_segmented, system_correlation_appended,
)


def entry(spark: SparkSession) -> DataFrame:
    """Portfolio return next to the benchmark, per day."""
    return daily_equity_vs_benchmark(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns and rows as the query of that name."""
    return ORACLES | LLM_ORACLES
