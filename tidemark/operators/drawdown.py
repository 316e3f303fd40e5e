"""Drawdowns: underwater curves, the current one, episodes of resampled curves, the worst ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import by_date, rate_of, running
from .prefix import running_peak

METRICS = ("pct", "days")
SALTS = 64


def underwater(equity_abs: DataFrame) -> DataFrame:
    """Distance from the running peak in percent, 0 or below: date, system, dd_pct."""
    peak = F.max("equity").over(running(by_date()))
    return equity_abs.select("date", "system", rate_of(F.col("equity"), peak).alias("dd_pct"))


def underwater_by_segments(equity_abs: DataFrame, days_per_segment: int = 365) -> DataFrame:
    """``underwater`` of curves too long for one task: each is cut into segments of so many days, which carry their peak on."""
    segment = F.floor(F.unix_date("date") / days_per_segment)
    peaks = running_peak(equity_abs.select("date", "system", "equity"), "equity", ["system"], "date", segment, "peak")
    return peaks.select("date", "system", rate_of(F.col("equity"), F.col("peak")).alias("dd_pct"))


def current_drawdown(dd: DataFrame) -> DataFrame:
    """Latest drawdown of each system: system, dd_days, dd_pct, is_underwater.

    ``dd_days`` counts the rows since the last time the curve left its peak, to the end of the data,
    even if it has recovered since; ``dd_pct`` is the depth on the last date, without sign.
    """
    starts = (F.col("dd_pct") < 0) & (F.lag("dd_pct").over(by_date()) == 0)
    marked = dd.select("date", "system", "dd_pct", starts.alias("starts"),
                       F.count("dd_pct").over(running(by_date())).alias("row_no"))
    last_start = F.max(F.when(F.col("starts"), F.col("row_no")))
    last_dd = F.max_by("dd_pct", "date")
    return marked.groupBy("system").agg(
        F.coalesce(F.count("dd_pct") - last_start + 1, F.lit(0)).alias("dd_days"),
        F.abs(last_dd).alias("dd_pct"), (last_dd < 0).alias("is_underwater"))


def episodes_over(curves: DataFrame, curve_keys: list[str], order: list[Column]) -> DataFrame:
    """Episodes of curves identified by ``curve_keys`` and laid out by ``order``.

    The episodes are grouped by the same keys as the window, so they stay where the curves are.
    """
    so_far = running(W.partitionBy(*curve_keys).orderBy(*order))
    return _episodes(curves.withColumn("equity_high", F.max("equity").over(so_far)), curve_keys)


def _episodes(peaks: DataFrame, curve_keys: list[str]) -> DataFrame:
    depth = F.abs(rate_of(F.col("equity"), F.col("equity_high")))
    return (peaks.where("equity < equity_high").groupBy(*curve_keys, "equity_high")
            .agg(F.max(depth).alias("pct"), F.count(F.lit(1)).alias("days"))
            .select("system", "run", "equity_high", "pct", "days"))


def merge_equal_peaks(episodes: DataFrame) -> DataFrame:
    """Join episodes of one system that start from the same peak value in different runs.

    Keeps the greatest depth, the run it belongs to (lowest run on a tie), and the sum of days.
    """
    deepest = F.max(F.struct("pct", (-F.col("run")).alias("neg_run"))).alias("deepest")
    return (episodes.groupBy("system", "equity_high").agg(deepest, F.sum("days").alias("days"))
            .select("system", (-F.col("deepest.neg_run")).alias("run"), "equity_high",
                    F.col("deepest.pct").alias("pct"), "days"))


def drawdown_episodes(curves: DataFrame, merge_equal_peaks: bool = False) -> DataFrame:
    """One row per drawdown of each curve: system, run, equity_high, pct, days.

    ``merge_equal_peaks=True`` groups by peak value alone within a system.
    """
    episodes = episodes_over(curves, ["system", "run"], [F.col("step")])
    return _merge(episodes) if merge_equal_peaks else episodes


_merge = merge_equal_peaks


def drawdown_episodes_by_segments(curves: DataFrame, steps_per_segment: int = 100_000, merge_equal_peaks: bool = False) -> DataFrame:
    """``drawdown_episodes`` of curves too long for one task, cut into segments of so many steps.

    A segment gives its peak to the segments after it, and the part of each drawdown that lies in it: the greatest depth and
    the number of its days, which are joined across segments by the peak.
    """
    segment = F.floor(F.col("step") / steps_per_segment)
    keys = ["system", "run"]
    episodes = _episodes(running_peak(curves.select(*keys, "step", "equity"), "equity", keys, "step", segment, "equity_high"), keys)
    return _merge(episodes) if merge_equal_peaks else episodes


def sorted_episodes(episodes: DataFrame, metric: str = "pct") -> DataFrame:
    """Episodes, worst first by the chosen metric."""
    _check(metric)
    return episodes.orderBy(F.desc(metric), "system", "run", "equity_high")


def worst_drawdowns(episodes: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """Worst and n-th worst value per system: system, metric, worst_1, worst_n.

    With fewer than ``n`` episodes the last available one counts. The best ``n`` are taken in each of ``SALTS``
    parts of a system first, so that one system with most of the episodes does not meet in one task, whatever ``n``.
    """
    _check(metric)
    values = episodes.select("system", F.col(metric).cast("double").alias("value"), F.pmod(F.xxhash64("run", "equity_high"), F.lit(SALTS)).alias("salt"))
    for keys in (["system", "salt"], ["system"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value")))
        values = values.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    return values.groupBy("system").agg(F.lit(metric).alias("metric"), F.max("value").alias("worst_1"), F.min("value").alias("worst_n"))


def drawdown_vs_resample(current: DataFrame, worst: DataFrame, metric: str) -> DataFrame:
    """Current drawdown next to the band of worst resampled ones: system, metric, current, worst_n, worst_1."""
    _check(metric)
    now = current.select("system", F.col(f"dd_{metric}").cast("double").alias("current"))
    return (worst.where(F.col("metric") == metric).join(now, "system", "left")
            .select("system", "metric", "current", "worst_n", "worst_1"))


def _check(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
