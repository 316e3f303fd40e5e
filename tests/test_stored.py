"""Tables laid out by month, and tables that are rebuilt while they are read."""

import pathlib

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from helpers import day, plan_of, trades
from tidemark.plans import publish_episodes
from tidemark.sinks import live_versions
from test_resample import backtest


def table(spark, **rows):
    return spark.createDataFrame([(k, x) for k, xs in rows.items() for x in xs], "system string, x int")


def content(spark, path):
    return sorted((r.system, r.x) for r in tm.read_published(spark, path, "system").collect())


def test_one_key_is_replaced_and_others_stay(spark, tmp_path):
    p = str(tmp_path / "t")
    tm.publish(table(spark, a=[1, 2], b=[3], c=[4]), p, "system")
    before = tm.read_published(spark, p, "system")
    tm.publish(table(spark, b=[5, 6]), p, "system", only=["b"])
    assert content(spark, p) == [("a", 1), ("a", 2), ("b", 5), ("b", 6), ("c", 4)]
    tm.publish(table(spark, b=[7]), p, "system", only=["b", "c"])  # c has no rows any more
    assert content(spark, p) == [("a", 1), ("a", 2), ("b", 7)]
    assert sorted(map(tuple, before.select("system", "x").collect())) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]  # a reader keeps what it began with
    plan = plan_of(tm.read_published(spark, p, "system"))
    assert plan.count("PartitionFilters: [") == 2
    tm.publish(table(spark, d=[9]), p, "system")
    assert content(spark, p) == [("d", 9)] and live_versions(spark, p)[1] == {}


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no table"):
        tm.read_published(spark, p, "system")
    with pytest.raises(ValueError, match="nothing to refresh"):
        tm.publish(table(spark, a=[1]), p, "system", only=["a"])
    tm.publish(table(spark, a=[1], b=[2]), p, "system")
    broken = table(spark, a=[8, 9]).withColumn("x", F.when(F.col("x") == 9, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("x")))
    for only in (None, ["a"]):
        with pytest.raises(Exception, match="broken"):
            tm.publish(broken, p, "system", only=only)
        assert content(spark, p) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="not to be refreshed"):
        tm.publish(table(spark, b=[8]), p, "system", only=["a"])
    tm.publish(table(spark, a=[3]), p, "system", only=["a"])
    assert content(spark, p) == [("a", 3), ("b", 2)]


def test_keys_are_text_and_may_be_missing(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = spark.createDataFrame([("01", 1), ("1", 2), (None, 3), ("x y/z=", 4)], "system string, x int")
    tm.publish(rows, p, "system")
    tm.publish(rows.where("x = 1").withColumn("x", F.lit(5)), p, "system", only=["01"])
    got = {(r.system, r.x) for r in tm.read_published(spark, p, "system").collect()}
    assert got == {("01", 5), ("1", 2), (None, 3), ("x y/z=", 4)}


def test_folders_are_replaced(spark, tmp_path):
    p = str(tmp_path / "t")
    tm.write_table(table(spark, a=[1], b=[2]), p, partition_by=["system"])
    tm.write_table(table(spark, b=[3]), p, "replace_parts", partition_by=["system"])
    assert sorted((r.system, r.x) for r in tm.read_table(spark, p).collect()) == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError, match="needs partition_by"):
        tm.write_table(table(spark, a=[1]), p, "replace_parts")


def test_episodes_of_one_system_are_refreshed(spark, tmp_path):
    p, rows = str(tmp_path / "e"), backtest(spark)
    publish_episodes(rows, p, 12, 3)
    more = rows.unionByName(backtest(spark, {"B": [50.0, 45.0, 44.0, 60.0, 20.0]}).where("date > date'2022-01-05'"))
    publish_episodes(more, p, 12, 3, systems=["B"])
    want = tm.resampled_episodes(rows, 12, 3).where("system = 'A'").union(tm.resampled_episodes(more, 12, 3).where("system = 'B'"))
    columns = ["system", "run", "equity_high", "pct", "days"]
    got = tm.read_published(spark, p, "system").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(columns).collect()))


def spoil(path, *kept):
    """Make all months but some unreadable: a query that opens them fails."""
    for file in pathlib.Path(path).glob("stored_month=2022*/*.parquet"):
        if not any(f"stored_month={m}/" in str(file) for m in kept):
            file.write_bytes(b"not a table")
    for crc in pathlib.Path(path).rglob(".*.crc"):
        crc.unlink()


@pytest.fixture
def monthly(spark, tmp_path):
    path = str(tmp_path / "trades")
    rows = [(f"2022-{m:02d}-{d:02d}", "A", m * d) for m in range(1, 13) for d in (1, 15, 28)] + [(None, "A", 1)]
    tm.write_by_month(trades(spark, *rows), path, "exit_date")
    return path


def test_a_range_opens_its_months_only(spark, monthly):
    rows = tm.read_by_month(spark, monthly, "exit_date", day("2022-02-01"), day("2022-03-15"))
    plan = plan_of(rows)
    assert "stored_month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThan(exit_date,2022-02-01)" in plan
    spoil(monthly, 202202, 202203)
    assert sorted(str(r.exit_date) for r in rows.collect()) == ["2022-02-15", "2022-02-28", "2022-03-01", "2022-03-15"]


def test_a_calendar_opens_its_months_only(spark, monthly, tmp_path):
    spark.createDataFrame([(day(d), m) for d, m in (("2022-07-15", 7), ("2022-07-16", 7), ("2022-02-28", 7), ("2022-05-01", 5))],
                          "date date, month int").write.parquet(str(tmp_path / "cal"))
    rows = tm.on_days(tm.read_by_month(spark, monthly), "exit_date", spark.read.parquet(str(tmp_path / "cal")).where("month = 7"))
    assert "dynamicpruning" in plan_of(rows)
    spoil(monthly, 202202, 202207)
    assert sorted(str(r.exit_date) for r in rows.collect()) == ["2022-02-28", "2022-07-15"]


def test_rows_without_the_date_and_sorted_files(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = trades(spark, *[(f"2022-01-{1 + k % 28:02d}", "A", k) for k in range(500)], (None, "B", 1))
    tm.write_by_month(rows, p, "exit_date", rows_per_file=100)
    back = tm.read_by_month(spark, p)
    assert back.count() == 501 and back.where("stored_month is null").count() == 1
    for file in pathlib.Path(p).glob("stored_month=202201/*.parquet"):
        dates = [r.exit_date for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert dates == sorted(dates) and len(dates) <= 100
