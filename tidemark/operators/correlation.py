"""Correlation of system curves, without ever pairing systems up date by date."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.shared import spool

SYSTEMS_PER_BLOCK = 256
#: Rows of a curve in a chunk of the rolling correlation, and parts into which the systems of a chunk are dealt.
ROWS_PER_CHUNK, PARTS = 256, 32


def centred_vectors(series: DataFrame, value: str) -> DataFrame:
    """One row per system: the days on which it has a value, the values less their mean, and the mean."""
    x = F.col(value).cast("double")
    known = series.where(x.isNotNull() & ~F.isnan(x))
    mean = F.avg(x).over(W.partitionBy("system"))
    centred = known.select("system", F.unix_date("date").alias("day"), (x - mean).alias("x"), mean.alias("mean"))
    sorted_points = F.array_sort(F.collect_list(F.struct("day", "x")))
    twice = F.raise_error(F.concat(F.lit("two values on one date of system "), F.col("system"))).cast("array<struct<day:int,x:double>>")
    points = centred.groupBy("system").agg(sorted_points.alias("points"), F.max("mean").alias("mean"))
    once = F.size(F.array_distinct("points.day")) == F.size("points")
    points = points.withColumn("points", F.when(once, F.col("points")).otherwise(twice))
    every = series.select("system").distinct().join(points, "system", "left")
    return every.select("system", F.col("points.day").alias("day"), F.col("points.x").alias("x"), "mean")


def _block_correlation():
    """The function of a pair of blocks; it carries all it needs, so workers need not have this package."""

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf[pdf["block"] == pdf["low"]], pdf[pdf["block"] == pdf["high"]]
        days = [np.asarray(d if d is not None else [], dtype=np.int64) for d in pdf["day"]]
        axis = np.unique(np.concatenate(days)) if days else np.zeros(0, np.int64)

        def side(part):
            values, known = np.zeros((len(part), len(axis))), np.zeros((len(part), len(axis)))
            for i, (d, x) in enumerate(zip(part["day"], part["x"])):
                if d is not None:
                    at = np.searchsorted(axis, np.asarray(d, dtype=np.int64))
                    values[i, at], known[i, at] = np.asarray(x, dtype=float), 1.0
            return values, known

        def triples(left, right, corr):
            return pd.DataFrame({"system_a": np.repeat(left["system"].to_numpy(), len(right)),
                                 "system_b": np.tile(right["system"].to_numpy(), len(left)), "corr": corr.ravel()})

        if low.empty or high.empty:
            return triples(low, high, np.empty(0))
        (x, m), (y, k) = side(low), side(high)
        n = m @ k.T
        with np.errstate(all="ignore"):
            sx, sy, xx, yy = x @ k.T, m @ y.T, (x * x) @ k.T, m @ (y * y).T
            vx, vy = xx - sx * sx / n, yy - sy * sy / n
            corr = (x @ y.T - sx * sy / n) / np.sqrt(vx * vy)
            # a series without change on the common dates keeps at most a rounding error
            corr[(n < 2) | (vx <= 1e-14 * xx) | (vy <= 1e-14 * yy) | ~np.isfinite(corr)] = np.nan
        corr = np.clip(corr, -1.0, 1.0)
        if pdf["low"].iloc[0] == pdf["high"].iloc[0]:
            upper = np.triu(corr, 1)
            return triples(low, high, upper + upper.T + np.diag(np.where(np.isnan(np.diag(corr)), np.nan, 1.0)))
        return pd.concat([triples(low, high, corr), triples(high, low, corr.T)])

    return correlate


def system_correlation(equity_abs: DataFrame, value: str = "equity") -> DataFrame:
    """Pearson correlation of every two systems: system_a, system_b, corr.

    Both orders and the diagonal are returned, as in a matrix. A constant series gives NULL
    throughout, its diagonal included. Two systems are compared on the dates on which both have a value; two
    values of a system on one date are an error.

    Systems are hashed into blocks of about ``SYSTEMS_PER_BLOCK``; each pair of blocks is one
    group whose size is bounded by block size x dates, and one matrix product computes it. The
    only pairs that are ever produced are the result rows. The centred curves are stored
    first: their number sets the number of blocks, and they are needed once per block.
    """
    vectors = spool(centred_vectors(equity_abs, value), "centred-curves")
    blocks = max(1, math.ceil(vectors.count() / SYSTEMS_PER_BLOCK))
    block = F.pmod(F.xxhash64("system"), F.lit(blocks)).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    paired = vectors.select("*", block).select("*", other).select(
        "system", "day", "x", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    out = paired.groupBy("low", "high").applyInPandas(
        _block_correlation(), "system_a string, system_b string, corr double")
    return out.withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))


def _rolling_sums(lookback: int):
    """The function that streams sorted rows of (chunk, part, system, row_no, day, x); it carries all it needs, as above.

    For each chunk and part it sums over systems the values of every window, standardised inside the window. It holds one
    curve's rows of a chunk and one sum per date and place in the window, however many systems there are.
    """

    def standardised(x: np.ndarray) -> np.ndarray:
        """One row per window that ends on a row of x; windows that are short, flat or have a gap count as 0."""
        out = np.zeros((len(x), lookback))
        if len(x) >= lookback:
            w = np.lib.stride_tricks.sliding_window_view(x, lookback)
            with np.errstate(all="ignore"):
                z = (w - w.mean(axis=1)[:, None]) / w.std(axis=1)[:, None]
            usable = (w.max(axis=1) > w.min(axis=1)) & np.isfinite(z).all(axis=1)
            out[lookback - 1:][usable] = z[usable]
        return out

    def roll(batches):
        days, systems, table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, lookback))
        at = curve = None
        rows: list[tuple] = []

        def close_curve():
            nonlocal days, systems, table
            if not rows:
                return
            day, x, own = (np.concatenate(c) for c in zip(*rows))
            rows.clear()
            z, day = standardised(x)[own], day[own]
            if len(new := np.setdiff1d(day, days)):
                every = np.union1d(days, new)
                place, wider = np.searchsorted(every, days), (np.zeros(len(every), np.int64), np.zeros((len(every), lookback)))
                wider[0][place], wider[1][place] = systems, table
                days, (systems, table) = every, wider
            place = np.searchsorted(days, day)
            np.add.at(systems, place, 1)
            np.add.at(table, place, z)

        def close_chunk():
            nonlocal days, systems, table
            out = pa.RecordBatch.from_pydict({"day": pa.array(days, pa.int32()), "systems": pa.array(systems, pa.int64()),
                                              "z": pa.array(list(table), pa.list_(pa.float64()))})
            days, systems, table = days[:0], systems[:0], table[:0]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, part, day = (batch.column(c).to_numpy().astype(np.int64) for c in ("chunk", "part", "day"))
            x, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "own"))
            system = batch.column("system")
            name = system.dictionary_encode().indices.fill_null(-1).to_numpy()
            # a curve ends where its chunk, part or name changes
            cuts = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(part) != 0) | (np.diff(name) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                here, who = (chunk[i], part[i]), system[int(i)].as_py()
                if here != at or who != curve:
                    close_curve()
                    if here != at and len(days):
                        yield close_chunk()
                    at, curve = here, who
                rows.append((day[i:j], x[i:j].astype(float), own[i:j].astype(bool)))
        close_curve()
        if len(days):
            yield close_chunk()

    return roll


def _squares_of_sums(lookback: int):
    """The function that adds the parts of each date of a stretch: one row per date and part comes in, whatever the systems."""

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("day")
        day, first = np.unique(rows.column("day").to_numpy(), return_index=True)
        z = rows.column("z").combine_chunks().flatten().to_numpy().reshape(-1, lookback)
        sums = np.add.reduceat(z, first, axis=0)
        return pa.table({"day": pa.array(day, pa.int32()), "n": np.add.reduceat(rows.column("systems").to_numpy(), first),
                         "squares": (sums * sums).sum(axis=1)})

    return total


def rolling_dd_correlation(dd: DataFrame, lookback: int = 60, inactive: Iterable[str] = (),
                           value: str = "dd_pct") -> DataFrame:
    """Combined rolling correlation of all drawdown curves: date, combined_corr.

    Defined as ``(sum of the correlation matrix - n) / (2 n)`` over the ``lookback`` rows that end
    on the date, where ``n`` counts the systems that have any drawdown and are not ``inactive``.
    A system that is flat inside the window adds nothing, but still counts in ``n``. The first
    ``lookback`` dates are left out.

    The matrix itself is never built: with every curve standardised inside its window, the sum over all pairs equals the mean
    over the window of the squared sum over systems, so the work grows with the number of systems, not its square.
    Curves are cut into chunks of ``ROWS_PER_CHUNK`` rows that overlap by the lookback, so every window lies whole in
    one chunk; the systems of a chunk are dealt to ``PARTS`` parts, each read as a sorted stream. Ahead of the second shuffle
    a part is one row per date, whatever its systems; there the parts of a date are added.
    """
    whole = W.partitionBy("system")
    row_no = F.row_number().over(whole.orderBy("date")) - 1
    active = (dd.where(~F.col("system").isin(list(inactive)))
              .select("system", F.unix_date("date").alias("day"), F.col(value).cast("double").alias("x"), row_no.alias("row_no"),
                      F.sum(value).over(whole).alias("total")).where("total != 0"))
    home = F.floor(F.col("row_no") / ROWS_PER_CHUNK).cast("int")
    # a row is needed by its own chunk and, near its end, by those whose windows reach back to it
    reached = F.floor((F.col("row_no") + lookback - 1) / ROWS_PER_CHUNK).cast("int")
    rows = active.select("system", "day", "x", "row_no", home.alias("home"), F.explode(F.sequence(home, reached)).alias("chunk"),
                         F.pmod(F.xxhash64("system"), F.lit(PARTS)).cast("int").alias("part"))
    keys = ["chunk", "part", "system", "row_no"]
    sums = (rows.select(*keys, "day", "x", (F.col("home") == F.col("chunk")).alias("own"))
            .repartition("chunk", "part").sortWithinPartitions(*keys)
            .mapInArrow(_rolling_sums(lookback), "day int, systems long, z array<double>"))
    per_date = (sums.groupBy(F.floor(F.col("day") / ROWS_PER_CHUNK).alias("days"))
                .applyInArrow(_squares_of_sums(lookback), "day int, n long, squares double"))
    n = F.col("n")
    return (per_date.select(F.date_from_unix_date("day").alias("date"), ((F.col("squares") / lookback - n) / (2 * n)).alias("combined_corr"),
                            F.row_number().over(W.orderBy("day")).alias("row_no"))
            .where(F.col("row_no") > lookback).drop("row_no"))
