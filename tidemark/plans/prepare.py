"""Batch job: load the inputs, resample the backtest, store every table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import business_calendar, of_systems, permutation_resample, resampled_episodes
from ..sinks import publish, write_table
from ..sources import load_backtest, load_bars, load_open_pl, load_trades, read_table

TABLES = ("bars", "open_pl", "trades", "backtest", "curves", "episodes", "calendar")


def prepare(spark: SparkSession, inputs: dict[str, str], out_dir: str, calendar_floor: dt.date,
            runs: int = 100, seed: int = 42, merge_equal_peaks: bool = False,
            folder_per_system: bool = True) -> dict[str, DataFrame]:
    """Rebuild all stored tables under ``out_dir`` and return them.

    ``inputs`` names the files or folders of ``bars``, ``trades``, ``open_pl`` and ``backtest``.
    Each table is derived from stored ones, never from the raw files again. Episodes come straight from
    the stored backtest: going through the stored curves would shuffle ``runs + 1`` times as many rows
    to save one sort. Curves and episodes get a folder per system, since reports pick one system; turn
    that off when there are many thousands of systems.
    """
    layout = ["system"] if folder_per_system else []

    def store(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        write_table(df, f"{out_dir}/{name}", "replace", partition_by=partition_by or [])
        return read_table(spark, f"{out_dir}/{name}")

    stored = {
        "bars": store("bars", load_bars(spark, inputs["bars"])),
        "open_pl": store("open_pl", load_open_pl(spark, inputs["open_pl"])),
        "trades": store("trades", load_trades(spark, inputs["trades"])),
        "backtest": store("backtest", load_backtest(spark, inputs["backtest"])),
    }
    backtest = stored["backtest"]
    stored["curves"] = store("curves", permutation_resample(backtest, runs, seed), layout)
    stored["episodes"] = store("episodes", resampled_episodes(backtest, runs, seed, merge_equal_peaks), layout)
    stored["calendar"] = store("calendar", business_calendar(stored["bars"], calendar_floor))
    return stored


def publish_episodes(backtest: DataFrame, path: str, runs: int = 100, seed: int = 42, merge_equal_peaks: bool = False,
                     systems: Sequence[str] | None = None) -> str:
    """Store the episodes of all systems, or replace those of some; readers see each system as it was or as it is.

    Only the chosen systems' backtest rows are resampled. Read with ``read_published(spark, path, "system")``.
    """
    rows = backtest if systems is None else of_systems(backtest, systems)
    return publish(resampled_episodes(rows, runs, seed, merge_equal_peaks).hint("rebalance", "system"), path, "system", systems)
