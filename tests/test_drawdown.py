import pytest

import tidemark as tm
from helpers import as_map, plan_of, series
from tidemark.plans import key_metrics


def test_underwater(spark):
    eq = series(spark, "equity", ("2022-01-03", "A", 100.0), ("2022-01-04", "A", 80.0), ("2022-01-05", "A", 110.0),
                ("2022-01-06", "A", 99.0), ("2022-01-03", "Z", 0.0), ("2022-01-04", "Z", 0.0))
    got = as_map(tm.underwater(eq), "date", "system")
    assert [got[(f"2022-01-0{d}", "A")] for d in (3, 4, 5, 6)] == [0, pytest.approx(-20), 0, pytest.approx(-10)]
    assert got[("2022-01-04", "Z")] is None


def test_current_drawdown(spark):
    def rows(system, *values):
        return [(f"2022-01-{3 + i:02d}", system, v) for i, v in enumerate(values)]

    dd = series(spark, "dd_pct", *rows("open", 0.0, -1.0, 0.0, -2.0, -3.5), *rows("recovered", 0.0, -1.0, -2.0, 0.0, 0.0),
                *rows("never", 0.0, 0.0), *rows("from_start", -1.0, -2.0), *rows("gap", 0.0, -1.0, None, -2.0))
    assert as_map(tm.current_drawdown(dd), "system") == {
        "open": (2, 3.5, True), "recovered": (4, 0.0, False), "never": (0, 0.0, False),
        "from_start": (0, 2.0, True), "gap": (2, 2.0, True)}
    assert as_map(key_metrics(tm.current_drawdown(dd)), "system")["open"] == (3.5, 2)


def curves(spark, *rows):
    data = [(s, run, step, v) for s, run, values in rows for step, v in enumerate(values)]
    return spark.createDataFrame(data, "system string, run int, step int, equity double")


def test_episodes_per_run_and_merged(spark):
    c = curves(spark, ("A", 0, [100.0, 90.0, 95.0, 120.0, 60.0]), ("A", 1, [100.0, 80.0, 130.0, 130.0]),
               ("B", 0, [1.0, 2.0, 3.0]))
    got = as_map(tm.drawdown_episodes(c), "system", "run", "equity_high")
    assert got == {("A", "0", "100.0"): (pytest.approx(10), 2), ("A", "0", "120.0"): (pytest.approx(50), 1),
                   ("A", "1", "100.0"): (pytest.approx(20), 1)}
    merged = {(r.system, r.equity_high): (r.run, r.pct, r.days)
              for r in tm.drawdown_episodes(c, merge_equal_peaks=True).collect()}
    assert merged == {("A", 100.0): (1, pytest.approx(20), 3), ("A", 120.0): (0, pytest.approx(50), 1)}


def test_merge_takes_the_lowest_run_on_a_tie(spark):
    c = curves(spark, *[("A", run, [100.0, 90.0]) for run in (3, 1, 2)])
    assert tm.drawdown_episodes(c, merge_equal_peaks=True).select("run", "days").first() == (1, 3)


def episodes(spark, **pcts):
    rows = [(s, i, float(i), float(p), int(p) * 2) for s, ps in pcts.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "system string, run int, equity_high double, pct double, days bigint")


def test_worst_and_nth_worst(spark):
    e = episodes(spark, A=[5, 1, 9, 7, 7], B=[2])
    assert as_map(tm.worst_drawdowns(e, "pct", 3), "system") == {"A": ("pct", 9.0, 7.0), "B": ("pct", 2.0, 2.0)}
    assert as_map(tm.worst_drawdowns(e, "days", 10), "system") == {"A": ("days", 18.0, 2.0), "B": ("days", 4.0, 4.0)}
    assert "WindowGroupLimit" in plan_of(tm.worst_drawdowns(e, "pct", 3))
    assert [r.pct for r in tm.sorted_episodes(e, "pct").collect()] == [9, 7, 7, 5, 2, 1]
    with pytest.raises(ValueError, match="metric"):
        tm.worst_drawdowns(e, "pct; drop table x")


def test_current_next_to_resampled(spark):
    worst = tm.worst_drawdowns(episodes(spark, A=[5, 9], B=[3]), "days", 2)
    current = spark.createDataFrame([("A", 4, 1.5, True)], "system string, dd_days bigint, dd_pct double, is_underwater boolean")
    got = as_map(tm.drawdown_vs_resample(current, worst, "days"), "system")
    assert got == {"A": ("days", 4.0, 10.0, 18.0), "B": ("days", None, 6.0, 6.0)}
