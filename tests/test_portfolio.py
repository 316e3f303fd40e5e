import pytest

import tidemark as tm
from helpers import as_map, bars, calendar, day, open_pl, trades

FROM, TO = day("2021-12-31"), day("2022-12-31")


def test_null_until_first_close_then_restarts_at_capital(spark):
    cal = calendar(spark, "2021-12-31", "2022-01-03", "2022-01-04", "2022-01-05", "2022-01-06")
    t = trades(spark, ("2021-12-31", "A", 500), ("2022-01-05", "A", 10), ("2022-01-06", "B", -5))
    o = open_pl(spark, ("2022-01-03", "A", 7), ("2022-01-05", "A", 2))
    got = as_map(tm.daily_equity(cal, t, o, 100, FROM, TO), "date")
    assert got == {"2022-01-03": None, "2022-01-04": None, "2022-01-05": pytest.approx(12.0),
                   "2022-01-06": pytest.approx(5.0)}


def test_off_calendar_and_unclosed_trades_do_not_count(spark):
    cal = calendar(spark, "2022-01-03", "2022-01-05")
    t = trades(spark, ("2022-01-03", "A", 1), ("2022-01-04", "A", 50), (None, "A", 70))
    got = as_map(tm.daily_equity(cal, t, open_pl(spark), 100, FROM, TO), "date")
    assert got == {"2022-01-03": pytest.approx(1.0), "2022-01-05": pytest.approx(1.0)}


def test_range_excludes_its_start_and_includes_its_end(spark):
    cal = calendar(spark, "2022-01-03", "2022-01-04", "2022-01-05")
    t = trades(spark, ("2022-01-03", "A", 1), ("2022-01-04", "A", 2), ("2022-01-05", "A", 4))
    got = as_map(tm.daily_equity(cal, t, open_pl(spark), 100, day("2022-01-03"), day("2022-01-04")), "date")
    assert got == {"2022-01-04": pytest.approx(2.0)}


def test_no_capital_gives_null(spark):
    cal, t = calendar(spark, "2022-01-03"), trades(spark, ("2022-01-03", "A", 1))
    assert as_map(tm.daily_equity(cal, t, open_pl(spark), 0, FROM, TO), "date") == {"2022-01-03": None}
    assert as_map(tm.monthly_returns(cal, t, open_pl(spark), 0, FROM, TO), "ym") == {"2022-01": None}


BARS = [("2022-01-03", 100.0), ("2022-01-04", 110.0), ("2022-01-05", 121.0), ("2022-01-06", 133.1)]


def test_benchmark_base_lies_before_the_range(spark):
    b = bars(spark, *BARS)
    assert tm.benchmark_base(b, day("2022-01-04"), TO).first()[0] == 110.0
    # The range starts at the first stored bar: that bar's own close.
    assert tm.benchmark_base(b, FROM, TO).first()[0] == 100.0
    assert tm.benchmark_base(b, day("2022-01-06"), TO).first()[0] is None


def test_equity_next_to_benchmark(spark):
    cal = calendar(spark, "2022-01-05", "2022-01-06", "2022-01-07")
    t = trades(spark, ("2022-01-05", "A", 3))
    got = as_map(tm.daily_equity_vs_benchmark(cal, t, open_pl(spark), bars(spark, *BARS), 100, day("2022-01-04"), TO),
                 "date")
    assert got["2022-01-05"] == (pytest.approx(3.0), pytest.approx(10.0))
    assert got["2022-01-06"] == (pytest.approx(3.0), pytest.approx(21.0))
    assert got["2022-01-07"] == (pytest.approx(3.0), None)


def test_months_run_in_calendar_order_across_years(spark):
    cal = calendar(spark, "2021-01-29", "2021-02-26", "2022-01-31", "2022-02-28")
    t = trades(spark, ("2021-01-29", "A", 1), ("2021-02-26", "A", 2), ("2022-01-31", "A", 4), ("2022-02-28", "A", 8))
    got = as_map(tm.monthly_returns(cal, t, open_pl(spark), 100, day("2020-12-31"), TO), "ym")
    assert got == {"2021-01": pytest.approx(1), "2021-02": pytest.approx(3), "2022-01": pytest.approx(7),
                   "2022-02": pytest.approx(15)}


def test_month_end_open_profit_counts_in_each_month(spark):
    cal = calendar(spark, "2022-01-03", "2022-01-31", "2022-02-28", "2022-03-31")
    t = trades(spark, ("2022-01-03", "A", 1), ("2022-02-28", "A", 1))
    o = open_pl(spark, ("2022-01-03", "A", 99), ("2022-01-31", "A", 10), ("2022-02-28", "A", 10),
                ("2022-03-31", "A", 50))
    got = as_map(tm.monthly_returns(cal, t, o, 100, FROM, TO), "ym")
    # March has open profit but no closed trade: nothing is added.
    assert got == {"2022-01": pytest.approx(11), "2022-02": pytest.approx(22), "2022-03": pytest.approx(22)}


def test_monthly_benchmark_uses_the_last_calendar_day(spark):
    cal = calendar(spark, "2022-01-04", "2022-01-06", "2022-02-01")
    t = trades(spark, ("2022-01-04", "A", 1))
    got = as_map(tm.monthly_returns_vs_benchmark(cal, t, open_pl(spark), bars(spark, *BARS), 100, FROM, TO), "ym")
    assert got == {"2022-01": (pytest.approx(1), pytest.approx(33.1)), "2022-02": (pytest.approx(1), None)}


def test_all_periods_equal_single_periods(spark):
    from tidemark.functions import PERIODS
    as_of, floor = day("2022-02-15"), day("2022-01-10")  # the floor lies inside other periods
    dates = [f"2021-{m:02d}-{d:02d}" for m in (10, 11, 12) for d in (5, 20)]
    dates += [f"2022-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (4, 12)]
    cal = calendar(spark, *dates)
    t = trades(spark, *[(d, "A", i + 1) for i, d in enumerate(dates)])
    o = open_pl(spark, *[(d, "A", 10 * i) for i, d in enumerate(dates) if i % 2])
    b = bars(spark, *[(d, 100.0 + i) for i, d in enumerate(dates)])
    bounds = as_map(tm.period_bounds(spark, as_of, floor).select("period", "date_from"), "period")
    assert set(bounds) == set(PERIODS)
    every = {
        "eq": (tm.daily_equity_all_periods(cal, t, o, 100, as_of, floor), "date"),
        "eqb": (tm.daily_equity_vs_benchmark_all_periods(cal, t, o, b, 100, as_of, floor), "date"),
        "mo": (tm.monthly_returns_all_periods(cal, t, o, 100, as_of, floor), "ym"),
        "mob": (tm.monthly_returns_vs_benchmark_all_periods(cal, t, o, b, 100, as_of, floor), "ym"),
    }
    every = {n: as_map(df, "period", key) for n, (df, key) in every.items()}
    for period, start in bounds.items():
        single = {
            "eq": as_map(tm.daily_equity(cal, t, o, 100, start, as_of), "date"),
            "eqb": as_map(tm.daily_equity_vs_benchmark(cal, t, o, b, 100, start, as_of), "date"),
            "mo": as_map(tm.monthly_returns(cal, t, o, 100, start, as_of), "ym"),
            "mob": as_map(tm.monthly_returns_vs_benchmark(cal, t, o, b, 100, start, as_of), "ym"),
        }
        for name, want in single.items():
            got = {k[1]: v for k, v in every[name].items() if k[0] == period}
            assert got == want, (period, name)
