import pytest

import tidemark as tm
from helpers import as_map, day, money, open_pl, plan_of, series, trades
from tidemark.plans import stored_system_equity

FROM, TO = day("2021-12-31"), day("2022-12-31")


def test_one_sided_records_and_unknown_systems(spark):
    t = trades(spark, ("2022-01-03", "A", 1), ("2022-01-03", "A", 2), ("2022-01-04", "B", 3), ("2021-12-31", "C", 9),
               (None, "D", 9))
    o = open_pl(spark, ("2022-01-04", "A", 5), ("2022-01-05", "C", 6), ("2022-01-05", "D", 7), ("2022-01-05", "E", 8))
    got = as_map(tm.system_daily_pl(t, o, FROM, TO), "date", "system")
    # C and D were traded outside the range or not closed yet, E was never traded.
    assert got == {("2022-01-03", "A"): (money(3), 0), ("2022-01-04", "A"): (0, money(5)),
                   ("2022-01-04", "B"): (money(3), 0), ("2022-01-05", "C"): (0, money(6)),
                   ("2022-01-05", "D"): (0, money(7))}


def test_chosen_systems(spark):
    t = trades(spark, ("2022-01-03", "A", 1), ("2022-01-04", "B", 3))
    o = open_pl(spark, ("2022-01-05", "B", 5), ("2022-01-05", "E", 8))
    assert set(as_map(tm.system_daily_pl(t, o, FROM, TO, ["B", "E"]), "date", "system")) == {
        ("2022-01-04", "B"), ("2022-01-05", "B"), ("2022-01-05", "E")}
    assert tm.system_daily_pl(t, o, FROM, TO, []).count() == 0


def equity(spark, t, o, capital=100, **shares):
    return stored_system_equity(t, o, tm.allocations(spark, shares), capital, FROM, TO)


def test_equity_on_one_dense_axis(spark):
    t = trades(spark, ("2022-01-03", "A", 1), ("2022-01-10", "A", 2), ("2022-01-05", "B", 4))
    o = open_pl(spark, ("2022-01-05", "A", 7), ("2022-01-12", "B", 3))
    got = as_map(equity(spark, t, o, A=0.5, B=0.75), "date", "system")
    assert got == {("2022-01-03", "A"): 51.0, ("2022-01-05", "A"): 58.0, ("2022-01-10", "A"): 53.0,
                   ("2022-01-12", "A"): 53.0, ("2022-01-03", "B"): 75.0, ("2022-01-05", "B"): 79.0,
                   ("2022-01-10", "B"): 79.0, ("2022-01-12", "B"): 82.0}


def test_percent_curve_starts_from_first_equity(spark):
    eq = series(spark, "equity", ("2022-01-03", "A", 50.0), ("2022-01-04", "A", 75.0), ("2022-01-05", "A", 25.0),
                ("2022-01-03", "Z", 0.0), ("2022-01-04", "Z", 5.0))
    got = as_map(tm.system_equity_pct(eq), "date", "system")
    assert got[("2022-01-03", "A")] == 0 and got[("2022-01-04", "A")] == 50 and got[("2022-01-05", "A")] == -50
    assert got[("2022-01-04", "Z")] is None


def test_missing_allocation_is_an_error(spark):
    with pytest.raises(Exception, match="no allocation for system B"):
        equity(spark, trades(spark, ("2022-01-03", "B", 1)), open_pl(spark), A=1.0).collect()


def test_wide_output(spark):
    eq = series(spark, "equity", ("2022-01-03", "A", 1.0), ("2022-01-03", "B", 2.0), ("2022-01-04", "A", 3.0))
    assert as_map(tm.system_equity_wide(eq, ["A", "B"]), "date") == {"2022-01-03": (1.0, 2.0), "2022-01-04": (3.0, None)}


def test_pct_change(spark):
    s = series(spark, "equity", ("2022-01-03", "A", 50.0), ("2022-01-04", "A", 0.0), ("2022-01-05", "A", 25.0))
    assert list(as_map(tm.daily_pct_change(s).orderBy("date"), "date", "system").values()) == [None, -100.0, None]


def test_blotter(spark):
    t = trades(spark, ("2022-01-03", "A", 1, "2022-01-02"), (None, "A", 2, "2022-01-03"),
               ("2022-02-03", "B", 3, "2022-01-04"), ("2025-01-01", "A", 4, "2024-12-01"))
    got = tm.trade_blotter(t, day("2022-01-02"), ["A"]).collect()
    assert [r.trade_id for r in got] == [3, 1]
    assert [r.trade_id for r in tm.trade_blotter(t, day("2022-01-02")).collect()] == [3, 2, 1]


def test_lists_and_counts(spark):
    t = trades(spark, ("2022-01-03", "a", 1), ("2022-01-04", "a", 3), ("2022-01-04", "B", 3))
    assert sorted(r[0] for r in tm.system_list(t).collect()) == ["B", "a"]
    assert sorted(r[0] for r in tm.backtest_systems(t).collect()) == ["A", "B"]
    assert as_map(tm.table_counts(trades=t, open_pl=open_pl(spark)), "table_name") == {"trades": 3, "open_pl": 0}


def test_no_product_of_dates_and_systems(spark):
    eq = equity(spark, trades(spark, ("2022-01-03", "A", 1)), open_pl(spark), A=1.0)
    assert "CartesianProduct" not in plan_of(eq) and "NestedLoop" not in plan_of(eq)
