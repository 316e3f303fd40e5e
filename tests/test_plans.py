import tidemark as tm
from helpers import as_map, day, plan_of
from tidemark.plans import portfolio_report, prepare, risk_report, system_report
from test_sources import wide_file, write


def prepared(spark, tmp_path, **options):
    days = ["2022-01-03", "2022-01-04", "2022-01-05", "2022-01-06"]
    inputs = {
        "bars": write(tmp_path / "b.csv", "Date,Open,High,Low,Close\n" + "".join(
            f"{d},1,1,1,{100 + i}\n" for i, d in enumerate(["2021-12-31", *days]))),
        "trades": write(tmp_path / "t.csv", "Trade ID,System,Action,Ticker,Entry date,Entry price,Quantity,Commission,"
                        "Exit date,Exit price,PL\n1,A,L,T,3/1/2022,1,1,0,4/1/2022,1,5\n"
                        "2,B,L,T,3/1/2022,1,1,0,5/1/2022,1,-2\n3,A,L,T,3/1/2022,1,1,0,6/1/2022,1,-3\n"),
        "open_pl": wide_file(tmp_path / "o.csv", ["03/01/2022", "04/01/2022"], ["A,T,1,1,1,2,,L,B,T,1,1,1,1,,L"]),
        "backtest": write(tmp_path / "bt.csv", "Date,a,b\n3/1/2022,100,50\n4/1/2022,90,55\n5/1/2022,110,52\n"),
    }
    return prepare(spark, inputs, str(tmp_path / "out"), day("2022-01-01"), **options)


def test_prepare_stores_every_table_and_can_be_repeated(spark, tmp_path):
    prepared(spark, tmp_path, runs=12)
    tables = prepared(spark, tmp_path, runs=12)
    counts = {n: t.count() for n, t in tables.items()}
    assert counts == {"bars": 5, "open_pl": 2, "trades": 3, "backtest": 6, "curves": 2 * 13 * 3,
                      "episodes": counts["episodes"], "calendar": 4}
    again = tm.drawdown_episodes(tables["curves"].select("system", "run", "step", "equity"))
    assert sorted(map(tuple, again.select(sorted(again.columns)).collect())) == sorted(
        map(tuple, tables["episodes"].select(sorted(again.columns)).collect()))
    # One folder per system: a report on one system reads that folder only.
    assert (tmp_path / "out" / "episodes" / "system=A").is_dir()
    assert "PartitionFilters: [isnotnull(system" in plan_of(tables["episodes"].where("system = 'A'"))


def test_reports(spark, tmp_path):
    tables = prepared(spark, tmp_path, runs=5)
    cal, t, o, b = (tables[n] for n in ("calendar", "trades", "open_pl", "bars"))
    alloc, span = tm.allocations(spark, {"A": 0.5, "B": 0.5}), (day("2021-12-31"), day("2022-12-31"))

    page = portfolio_report(cal, t, o, 100, *span)
    assert page["equity"].columns == ["date", "p_ret_pct"] and page["monthly"].count() == 1
    page = portfolio_report(cal, t, o, 100, *span, bars=b)
    assert as_map(page["equity"], "date")["2022-01-03"][0] is None and page["equity"].count() == 4

    page = system_report(t, o, alloc, 100, *span, systems=["A"])
    assert {r.system for r in page["equity_pct"].collect()} == {"A"}
    assert page["correlation"].count() == 1 and page["trades"].count() == 2

    page = risk_report(t, o, tables["episodes"], alloc, 100, *span, metric="days", lookback=2)
    assert as_map(page["key_metrics"], "system")["A"][1] == 1
    assert {r.system for r in page["distribution"].collect()} == {"A", "B"}
    assert page["rolling_correlation"].count() == 2 and page["underwater"].count() == 8
