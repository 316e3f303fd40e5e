"""What the plans promise: pruned and filtered scans, sums ahead of shuffles, hot keys kept whole."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from helpers import as_map, bars, day, money, open_pl, plan_of, trades
from tidemark import schemas

FROM, TO = day("2021-12-31"), day("2022-12-31")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    trades(spark, ("2022-01-03", "A", 1), ("2022-01-04", "B", 2)).write.parquet(f"{base}/trades")
    open_pl(spark, ("2022-01-03", "A", 1)).write.parquet(f"{base}/open_pl")
    return spark.read.parquet(f"{base}/trades"), spark.read.parquet(f"{base}/open_pl")


def scans(plan: str) -> list[tuple[set[str], str]]:
    """Columns read and filters pushed, per scan."""
    out = []
    for line in plan.splitlines():
        if "FileScan parquet" in line:
            columns = set(re.findall(r"(\w+):", line.split("ReadSchema: struct<")[1]))
            out.append((columns, line.split("PushedFilters: [")[1].split("], ReadSchema")[0]))
    return out


def test_daily_equity_reads_two_columns_of_the_range(stored):
    t, o = stored
    cal = t.select(F.col("exit_date").alias("date")).distinct()
    plan = plan_of(tm.daily_equity(cal, t, o, 100, FROM, TO))
    found = {frozenset(c): f for c, f in scans(plan)}
    for columns, date in (({"exit_date", "pl"}, "exit_date"), ({"date", "pl"}, "date")):
        pushed = found[frozenset(columns)]
        assert f"GreaterThan({date},2021-12-31)" in pushed and f"LessThanOrEqual({date},2022-12-31)" in pushed
    # Summed within each task before the rows are exchanged.
    assert plan.count("partial_sum(pl#") == 2
    # No task holds the whole calendar.
    for df in (tm.daily_equity(cal, t, o, 100, FROM, TO), tm.monthly_returns(cal, t, o, 100, FROM, TO)):
        assert "SinglePartition" not in plan_of(df) and plan_of(df).count("FileScan") == 3


def test_the_benchmark_reads_bars_once(spark, stored, tmp_path):
    t, o = stored
    bars(spark, ("2021-12-31", 1.0), ("2022-01-03", 2.0)).write.parquet(str(tmp_path / "bars"))
    b = spark.read.parquet(str(tmp_path / "bars"))
    cal = spark.createDataFrame([(day("2022-01-03"),)], "date date")
    for df in (tm.daily_equity_vs_benchmark(cal, t, o, b, 100, FROM, TO), tm.monthly_returns_vs_benchmark(cal, t, o, b, 100, FROM, TO),
               tm.daily_equity_vs_benchmark_all_periods(cal, t, o, b, 100, TO), tm.monthly_returns_vs_benchmark_all_periods(cal, t, o, b, 100, TO)):
        assert plan_of(df).count("FileScan") == 3
        assert [r[-1] for r in df.collect() if str(r[-3]).startswith("2022-01")] in ([100.0], [100.0] * 2)


def test_chosen_systems_reach_the_scan(stored):
    plan = plan_of(tm.system_daily_pl(*stored, FROM, TO, ["A", "B"]))
    assert all("In(system, [A,B])" in pushed for _, pushed in scans(plan)) and len(scans(plan)) == 2


def test_all_systems_sum_only_the_range(stored):
    plan = plan_of(tm.system_daily_pl(*stored, FROM, TO))
    assert len(scans(plan)) == 3
    assert plan.count("GreaterThan(exit_date") == 1 and plan.count("GreaterThan(date") == 1
    assert "ReadSchema: struct<system:string>" in plan


def test_hot_system_day_and_copies(spark):
    """One system, day and value in most rows: sums stay whole and reach the shuffle pre-aggregated."""
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("S"), (F.col("id") % 50).cast("string"))).otherwise("HOT")
        .alias("system"),
        F.when(F.col("id") % 4 == 0, F.date_add(F.lit(dt.date(2022, 1, 1)), (F.col("id") % 90).cast("int")))
        .otherwise(F.lit(dt.date(2022, 2, 2))).alias("exit_date"), F.lit(1).cast(schemas.MONEY).alias("pl"))
    nothing = open_pl(spark)
    got = tm.system_daily_pl(rows, nothing, FROM, TO)
    totals = as_map(got.groupBy("system").agg(F.sum("pl_closed")), "system")
    assert totals["HOT"] == money(40_000) and sum(totals.values()) == money(60_000)
    assert "partial_sum(pl_closed" in plan_of(got)


def test_properties_of_curves(spark):
    t = trades(spark, *[(f"2022-{m:02d}-{d:02d}", s, (m * d) % 7 - 3) for s in "ABC" for m in (1, 5, 9)
                        for d in range(1, 29, ord(s) - 60)])
    o = open_pl(spark, ("2022-03-03", "A", 5), ("2022-05-02", "B", -4))
    pl = tm.system_daily_pl(t, o, FROM, TO)
    assert pl.agg(F.sum("pl_closed")).first()[0] == t.agg(F.sum("pl")).first()[0]
    eq = tm.system_equity_abs(pl, tm.allocations(spark, dict.fromkeys("ABC", 0.5)), 1000)
    axis = pl.select("date").distinct().count()
    assert set(as_map(eq.groupBy("system").count(), "system").values()) == {axis}
    firsts = tm.system_equity_pct(eq).groupBy("system").agg(F.min_by("ret_pct", "date"))
    assert set(as_map(firsts, "system").values()) == {0.0}
    assert tm.underwater(eq).where("dd_pct > 0 or dd_pct is null").count() == 0
