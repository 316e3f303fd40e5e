"""Correlation that takes new dates: co-moments per pair of systems, which add up over stretches of dates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import spool
from .correlation import SYSTEMS_PER_BLOCK, centred_vectors

STATE = "system_a string, system_b string, n long, mean_a double, mean_b double, m2_a double, m2_b double, c_ab double"


def _block_moments():
    """The function of a pair of blocks; it carries all it needs, so workers need not have this package."""

    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf[pdf["block"] == pdf["low"]], pdf[pdf["block"] == pdf["high"]]
        days = [np.asarray(d if d is not None else [], dtype=np.int64) for d in pdf["day"]]
        axis = np.unique(np.concatenate(days)) if days else np.zeros(0, np.int64)

        def side(part):
            values, known = np.zeros((len(part), len(axis))), np.zeros((len(part), len(axis)))
            for i, (d, x) in enumerate(zip(part["day"], part["x"])):
                if d is not None:
                    at = np.searchsorted(axis, np.asarray(d, dtype=np.int64))
                    values[i, at], known[i, at] = np.asarray(x, dtype=float), 1.0
            return values, known, part["mean"].fillna(0.0).to_numpy(dtype=float)

        (x, m, mean_x), (y, k, mean_y) = side(low), side(high)
        n = m @ k.T
        with np.errstate(all="ignore"):
            # values are already less their own mean; what is left is the mean over the common dates
            ax, ay = np.where(n > 0, x @ k.T / n, 0.0), np.where(n > 0, m @ y.T / n, 0.0)
            m2x, m2y = (x * x) @ k.T - n * ax * ax, m @ (y * y).T - n * ay * ay
            c = x @ y.T - n * ax * ay
        a = np.repeat(np.arange(len(low)), len(high))
        b = np.tile(np.arange(len(high)), len(low))
        keep = (n.ravel() > 0) & ((low["system"].to_numpy()[a] <= high["system"].to_numpy()[b]) if pdf["low"].iloc[0] == pdf["high"].iloc[0] else True)
        return pd.DataFrame({"system_a": low["system"].to_numpy()[a], "system_b": high["system"].to_numpy()[b], "n": n.ravel().astype(np.int64),
                             "mean_a": (ax + mean_x[:, None]).ravel(), "mean_b": (ay + mean_y[None]).ravel(), "m2_a": m2x.ravel(),
                             "m2_b": m2y.ravel(), "c_ab": c.ravel()})[keep]

    return moments


def correlation_state(series: DataFrame, value: str = "equity") -> DataFrame:
    """Co-moments of every two systems over the dates on which both have a value: the columns of ``STATE``, once per pair.

    As in ``system_correlation``, pairs of hashed blocks are computed as matrix products, and pairs are produced only as result rows. Store the
    state of the dates so far; for new dates work out theirs alone and merge the two.
    """
    vectors = spool(centred_vectors(series, value), "moment-curves")
    blocks = max(1, math.ceil(vectors.count() / SYSTEMS_PER_BLOCK))
    block = F.pmod(F.xxhash64("system"), F.lit(blocks)).cast("int").alias("block")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    paired = vectors.select("*", block).select("*", other).select(
        "system", "day", "x", "mean", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = paired.groupBy("low", "high").applyInPandas(_block_moments(), STATE)
    # a pair of two blocks comes with its systems in either order; the smaller name goes first
    turned = F.col("system_a") > F.col("system_b")
    swap = {"system_a": "system_b", "system_b": "system_a", "mean_a": "mean_b", "mean_b": "mean_a", "m2_a": "m2_b", "m2_b": "m2_a"}
    return found.select(*[F.when(turned, F.col(swap.get(c, c))).otherwise(F.col(c)).alias(c) for c in found.columns])


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all dates from the states of parts that share no date. Parts are joined pair by pair of systems, a few rows each."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    parts = rows.groupBy("system_a", "system_b").agg(F.array_sort(F.collect_list(F.struct(*rows.columns[2:]))).alias("parts"))

    def joined(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        weight = a["n"] * b["n"] / n
        da, db = b["mean_a"] - a["mean_a"], b["mean_b"] - a["mean_b"]
        return F.struct(n.alias("n"), (a["mean_a"] + da * b["n"] / n).alias("mean_a"), (a["mean_b"] + db * b["n"] / n).alias("mean_b"),
                        (a["m2_a"] + b["m2_a"] + da * da * weight).alias("m2_a"), (a["m2_b"] + b["m2_b"] + db * db * weight).alias("m2_b"),
                        (a["c_ab"] + b["c_ab"] + da * db * weight).alias("c_ab"))

    total = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0)), joined)
    return parts.select("system_a", "system_b", total.alias("s")).select("system_a", "system_b", "s.*")


def correlation_of(state: DataFrame) -> DataFrame:
    """``system_correlation`` from a state: both orders and the diagonal. Pairs without a common date are left out."""
    # a series without change keeps at most a rounding error
    flat = (F.col("n") < 2) | (F.col("m2_a") <= 1e-14 * F.col("n") * F.pow("mean_a", F.lit(2))) | (F.col("m2_b") <= 1e-14 * F.col("n") * F.pow("mean_b", F.lit(2)))
    corr = F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c_ab") / F.sqrt(F.col("m2_a") * F.col("m2_b")))))
    pairs = state.select("system_a", "system_b", F.when(~flat & (F.col("system_a") == F.col("system_b")), 1.0).otherwise(corr).alias("corr"))
    back = pairs.where("system_a <> system_b").select(F.col("system_b").alias("system_a"), F.col("system_a").alias("system_b"), "corr")
    return pairs.unionByName(back)
