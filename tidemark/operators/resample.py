"""Seeded permutation resampling of backtest curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.stats import compound_from, round_to
from ..sources.shared import spool
from .drawdown import episodes_over, merge_equal_peaks

#: Unfolded rows that a task should have at most, and groups that a core should have at least.
ROWS_PER_TASK, GROUPS_PER_CORE = 1_000_000, 4
EQUITY_PLACES = 4

# Run first: a number decides most comparisons of the sort before the name has to be looked at.
_CURVE = ["run", "system", "run_block"]


def _daily_returns(backtest: DataFrame) -> DataFrame:
    """system, step, change, base. A gap keeps the last known equity, so its change is 0."""
    by_date = W.partitionBy("system").orderBy("date")
    known = (backtest.select("system", "date", F.last("equity", ignorenulls=True).over(by_date).alias("equity"),
                             F.first("equity").over(by_date).alias("base"),
                             (F.row_number().over(by_date) - 1).alias("step")))
    change = F.coalesce(F.try_divide(F.col("equity"), F.lag("equity").over(by_date)) - 1, F.lit(0.0))
    return known.select("system", "step", change.alias("change"), "base")


def block_plan(rows: int, systems: int, runs: int, cores: int) -> tuple[int, int]:
    """(runs per block, partitions) for ``rows`` backtest rows of ``systems`` curves.

    A block of runs is the unit that is shuffled once and unfolded in one task. It is as large as it may be, which saves
    copies, while its rows stay below ``ROWS_PER_TASK`` and there are ``GROUPS_PER_CORE`` units for each core.
    """
    rows, systems = max(rows, 1), max(systems, 1)
    fitting = ROWS_PER_TASK * systems // rows
    spread = systems * (runs + 1) // (GROUPS_PER_CORE * cores)
    per_block = max(1, min(fitting, spread, runs + 1))
    groups = systems * -(-(runs + 1) // per_block)
    return per_block, min(groups, max(cores * GROUPS_PER_CORE, -(-rows * (runs + 1) // ROWS_PER_TASK)))


def _laid_out(backtest: DataFrame, runs: int, seed: int) -> DataFrame:
    """Every run of every system: system, run_block, run, original step and its place in the run.

    Only one copy per block of runs goes through the shuffle; the runs of a block are unfolded on
    the receiving side, next to the windows that use them. The daily returns are stored and counted first; blocks and
    partitions follow from the count, not from a setting, and a fixed number keeps small inputs from being merged into one task
    ahead of the unfolding.
    """
    spark = backtest.sparkSession
    returns = spool(_daily_returns(backtest), "daily-returns")
    rows, systems = returns.agg(F.count(F.lit(1)), F.count_if(F.col("step") == 0)).first()
    per_block, partitions = block_plan(rows, systems, runs, spark.sparkContext.defaultParallelism)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(runs // per_block))).alias("run_block")
    first_run = F.col("run_block") * per_block
    members = F.sequence(first_run, F.least(first_run + (per_block - 1), F.lit(runs)))
    dealt = (returns.select("*", blocks).repartition(partitions, "system", "run_block")
             .select("*", F.explode(members).alias("run")))
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), F.col("run").cast("string"), F.lit("|"), F.col("system"),
                              F.lit("|"), F.col("step").cast("string")))
    in_order = F.lpad(F.col("step").cast("string"), 32, "0")
    return dealt.withColumn("place", F.when(F.col("run") == 0, in_order).otherwise(shuffled))


def _curves(backtest: DataFrame, runs: int, seed: int) -> DataFrame:
    by_place = W.partitionBy(*_CURVE).orderBy("place", "step")
    grown = compound_from(F.col("base"), F.col("change"), by_place)
    return _laid_out(backtest, runs, seed).select(
        *_CURVE, "place", "step",
        (F.row_number().over(by_place) - 1).alias("new_step"), grown.alias("grown"),
    ).withColumn("equity", round_to(F.col("grown"), EQUITY_PLACES)).drop("grown")


def permutation_resample(backtest: DataFrame, runs: int = 100, seed: int = 42) -> DataFrame:
    """Reshuffle each system's daily returns: system, run, step, equity (four decimals).

    Run 0 is the unshuffled curve; runs 1 to ``runs`` each reorder all its returns, the leading 0
    included, by the MD5 of seed, run, system and step. The order is a function of the data alone,
    so a lost task recomputes to the same curve. Every run of a system ends at the same equity.
    """
    return _curves(backtest, runs, seed).select("system", "run", F.col("new_step").alias("step"), "equity")


def resampled_episodes(backtest: DataFrame, runs: int = 100, seed: int = 42, merge_peaks: bool = False) -> DataFrame:
    """``drawdown_episodes(permutation_resample(...))`` without a second shuffle or sort of the curves."""
    episodes = episodes_over(_curves(backtest, runs, seed), _CURVE, [F.col("place"), F.col("step")])
    return merge_equal_peaks(episodes) if merge_peaks else episodes
