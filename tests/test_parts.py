"""Results put together from parts: running values by block, curves by segment, correlation by stretches of dates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

import tidemark as tm
import tidemark.operators.correlation as C
from helpers import plan_of
from tidemark.operators.prefix import month_block, running_total

DAY = dt.date(2021, 1, 1)


def frame(spark, seed, days=400, systems=3, gaps=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(systems):
        walk = 1000 + rng.integers(-20, 21, days).cumsum()
        rows += [(DAY + dt.timedelta(i), f"S{s}", float(walk[i])) for i in range(days) if rng.random() >= gaps]
    return spark.createDataFrame(rows, "date date, system string, equity double")


@pytest.mark.parametrize("group", [(), ("system",)])
def test_running_totals_equal_the_window(spark, group):
    rows = frame(spark, 1, gaps=0.3).withColumn("value", F.when(F.dayofyear("date") > 70, F.col("equity").cast("decimal(18,4)")))
    if not group:
        rows = rows.where("system = 'S0'")
    last = F.lit(2022 * 12 + 12)
    got = running_total(rows, "value", "date", month_block(F.col("date")), last, "total", group)
    want = rows.withColumn("total", F.sum("value").over(W.partitionBy(*group).orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert "SinglePartition" not in plan_of(got)
    assert running_total(rows.where("false"), "value", "date", month_block(F.col("date")), last, "total", group).count() == 0


@pytest.mark.parametrize("days", [1, 7, 1000])
def test_curves_cut_into_segments(spark, days):
    equity = frame(spark, 2)
    assert sorted(tm.underwater_by_segments(equity, days).collect()) == sorted(tm.underwater(equity).collect())
    curves = equity.select("system", F.lit(0).alias("run"), F.datediff("date", F.lit(DAY)).alias("step"), "equity")
    for merge in (False, True):
        assert sorted(tm.drawdown_episodes_by_segments(curves, days, merge).collect()) == sorted(tm.drawdown_episodes(curves, merge).collect())


def test_one_long_curve_is_spread(spark):
    """A drawdown that lasts over all segments but the first, and a peak that comes back."""
    values = [10.0, 20.0] + [15.0 - i % 3 for i in range(200)] + [20.0, 19.0, 25.0, 24.0]
    curves = spark.createDataFrame([("A", 0, i, v) for i, v in enumerate(values)], "system string, run int, step int, equity double")
    got = tm.drawdown_episodes_by_segments(curves, 10)
    assert sorted((r.equity_high, r.days) for r in got.collect()) == [(20.0, 201), (25.0, 1)]
    assert "SinglePartition" not in plan_of(got)


def rolling(series, lookback, inactive=()):
    """Plain pandas: the sum of each window's correlation matrix."""
    pdf = series.toPandas().pivot(index="date", columns="system", values="dd_pct").drop(columns=list(inactive), errors="ignore")
    pdf = pdf.loc[:, pdf.sum() != 0]
    n, out = len(pdf.columns), {}
    for i in range(lookback, len(pdf)):
        window, total = pdf.iloc[i - lookback + 1:i + 1], 0.0
        for a in pdf.columns:
            for b in pdf.columns:
                if window[a].nunique() > 1 and window[b].nunique() > 1:
                    total += np.corrcoef(window[a], window[b])[0, 1]
        out[str(pdf.index[i])] = (total - n) / 2 / n
    return out


@pytest.mark.parametrize("chunk, lookback, parts", [(256, 60, 32), (7, 20, 2), (50, 3, 1), (30, 90, 3)])
def test_rolling_correlation_in_chunks(spark, monkeypatch, chunk, lookback, parts):
    monkeypatch.setattr(C, "ROWS_PER_CHUNK", chunk)
    monkeypatch.setattr(C, "PARTS", parts)
    dd = tm.underwater(frame(spark, 3, days=150, systems=4)).withColumn("dd_pct", F.when(F.col("system") == "S3", F.least("dd_pct", F.lit(-1.0))).otherwise(F.col("dd_pct")))
    dd = dd.unionByName(dd.where("system = 'S0'").withColumns({"system": F.lit("never down"), "dd_pct": F.lit(0.0)}))
    got = {str(r.date): r.combined_corr for r in tm.rolling_dd_correlation(dd, lookback, inactive=["S1"]).collect()}
    want = rolling(dd, lookback, ["S1"])
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], abs=1e-9) for d in want)


def test_rolling_correlation_plan(spark, tmp_path):
    tm.underwater(frame(spark, 4)).write.parquet(str(tmp_path / "dd"))
    plan = plan_of(tm.rolling_dd_correlation(spark.read.parquet(str(tmp_path / "dd")), 60))
    assert "collect_list" not in plan and "posexplode" not in plan and plan.count("FileScan") == 1


def test_small_batches_do_not_change_the_rolling_sums(spark):
    dd, setting = tm.underwater(frame(spark, 5, days=120)), "spark.sql.execution.arrow.maxRecordsPerBatch"
    want, before = sorted(tm.rolling_dd_correlation(dd, 10).collect()), spark.conf.get(setting)
    spark.conf.set(setting, "13")
    try:
        got = sorted(tm.rolling_dd_correlation(dd, 10).collect())
    finally:
        spark.conf.set(setting, before)
    assert [r.date for r in got] == [r.date for r in want]
    assert [r.combined_corr for r in got] == pytest.approx([r.combined_corr for r in want])


@pytest.mark.parametrize("gaps, block", [(0.0, 256), (0.4, 2)])
def test_correlation_of_parts(spark, monkeypatch, gaps, block):
    import tidemark.operators.comoments as M
    monkeypatch.setattr(M, "SYSTEMS_PER_BLOCK", block)
    series = frame(spark, 6, days=90, systems=5, gaps=gaps)
    late = spark.createDataFrame([(DAY + dt.timedelta(i), s, v) for i in range(60, 90) for s, v in (("flat", 7.0), ("new", float(i % 7)))], series.schema)
    series = series.unionByName(late)
    cuts = [DAY + dt.timedelta(d) for d in (0, 30, 31, 65, 200)]
    states = [tm.correlation_state(series.where((F.col("date") >= a) & (F.col("date") < b))) for a, b in zip(cuts, cuts[1:])]
    got = {(r.system_a, r.system_b): r.corr for r in tm.correlation_of(tm.merge_states(*states)).collect()}
    want = {(r.system_a, r.system_b): r.corr for r in tm.system_correlation(series).collect()}
    assert got.keys() == want.keys()
    for pair, c in want.items():
        assert got[pair] is None if c is None else got[pair] == pytest.approx(c, abs=1e-9), pair
    again = {(r.system_a, r.system_b): r.corr for r in tm.correlation_of(tm.merge_states(tm.merge_states(*states[:2]), *states[2:])).collect()}
    assert again.keys() == got.keys() and all(again[p] == pytest.approx(c, abs=1e-9) if c is not None else again[p] is None for p, c in got.items())


def test_two_values_on_one_date_are_an_error(spark):
    series = frame(spark, 7, days=5, systems=2)
    for f in (tm.system_correlation, tm.correlation_state):
        with pytest.raises(Exception, match="two values on one date of system S1"):
            f(series.unionByName(series.where("system = 'S1'"))).collect()
