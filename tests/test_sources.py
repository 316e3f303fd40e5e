import csv
import datetime as dt

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from helpers import as_map, day, money, plan_of
from tidemark import schemas
from tidemark.sources import files, fresh_path, shared_dir, spool


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_bars(spark, tmp_path):
    p = write(tmp_path / "b.csv", "Date,Open,High,Low,Close,Volume,Dividends\n"
              "2022-03-31 00:00:00-04:00,1,2,0.5,1.5,10,0\n"
              "2022-04-01 00:00:00-04:00,1,,0.5,1.5,10,0\n"
              "2022-04-04,2,3,1.5,2.5,,0\n2022-04-05,3,4,2.5,3.5,10,0\n")
    got = tm.load_bars(spark, p)
    assert [f.name for f in got.schema] == schemas.BARS.names
    assert as_map(got, "date") == {"2022-03-31": (1, 2, 0.5, 1.5, 3, 2022), "2022-04-05": (3, 4, 2.5, 3.5, 4, 2022)}


def test_adjusted_close_takes_over(spark, tmp_path):
    p = write(tmp_path / "b.csv", "Date,Open,High,Low,Close,Adj Close\n2022-03-31,1,2,0.5,1.5,1.25\n")
    assert tm.load_bars(spark, p).first()["close"] == 1.25


def test_bars_from_parquet(spark, tmp_path):
    p = str(tmp_path / "b.parquet")
    spark.createDataFrame([(day("2022-03-31"), 1.0, 2.0, 0.5, 1.5, 3, 2022)], schemas.BARS).write.parquet(p)
    assert tm.load_bars(spark, p, "parquet").first()["close"] == 1.5


def test_trades(spark, tmp_path):
    p = write(tmp_path / "t.csv", " Trade ID ,System,Action,Ticker,Entry date,Entry price,Quantity,Commission,Exit date,"
              "Exit price,PL\n"
              '9007199254740993,A,L,"X, Y",1/2/2022,1.5,10,0.35,13/02/2022,2,4.6500\n'
              "2,B,S,Z,28/02/2022,3,5,1,,,\n3,A,L,Z,2022-03-04,3,5.0,1,05/03/2022,3,n/a\n")
    got = {r.trade_id: r for r in tm.load_trades(spark, p, on_bad="null").collect()}
    assert tm.load_trades(spark, p).schema == schemas.TRADES
    first = got[9007199254740993]
    assert (first.ticker, first.entry_date, first.exit_date, first.pl, first.commission) == (
        "X, Y", dt.date(2022, 2, 1), dt.date(2022, 2, 13), money("4.65"), money("0.35"))
    assert got[2].exit_date is None and got[2].pl is None and got[2].exit_price is None
    assert got[3].entry_date == dt.date(2022, 3, 4) and got[3].quantity == 5 and got[3].pl is None
    # The trade without an exit date is in no daily total.
    assert set(as_map(tm.closed_pl_by_date(tm.load_trades(spark, p, on_bad="null")), "date")) == {"2022-02-13", "2022-03-05"}
    with pytest.raises(Exception, match="not a decimal"):
        tm.load_trades(spark, p).collect()


HEAD = "System,Entry date,Exit date,PL\n"


def test_trades_with_quotes_and_date_forms(spark, tmp_path):
    p = write(tmp_path / "t.csv", HEAD + '"A ""b"", c",1-2-2021,2/2/21,50\nB,01.02.2021,,1\n')
    assert [(r.system, r.entry_date, r.exit_date, r.pl) for r in tm.load_trades(spark, p).orderBy("system").collect()] == [
        ('A "b", c', dt.date(2021, 2, 1), dt.date(2021, 2, 2), money(50)), ("B", dt.date(2021, 2, 1), None, money(1))]
    bad = write(tmp_path / "bad.csv", HEAD + "A,1/2/2021,soon,5\n")
    with pytest.raises(Exception, match="not a date: soon"):
        tm.load_trades(spark, bad).collect()
    with pytest.raises(ValueError, match="no column PL"):
        tm.load_trades(spark, write(tmp_path / "pl.csv", HEAD.replace("PL", "P/L") + "A,1/2/2021,,5\n"))


def test_files_of_a_folder_are_read_by_their_own_headers(spark, tmp_path):
    write(tmp_path / "a.csv", "Date,AAA,BBB\n1/1/2022,1,2\n")
    write(tmp_path / "b.csv", "\ufeff bbb , Date,aaa\r\n2,2/1/2022,1\r\n\r\n4,3/1/2022\r\n")
    write(tmp_path / "c.csv", 'Date,"C, 1"\n1/1/2022,"1000"\n')
    got = as_map(tm.load_backtest(spark, str(tmp_path)), "date", "system")
    assert got == {("2022-01-01", "AAA"): 1, ("2022-01-01", "BBB"): 2, ("2022-01-02", "AAA"): 1, ("2022-01-02", "BBB"): 2,
                   ("2022-01-03", "AAA"): None, ("2022-01-03", "BBB"): 4, ("2022-01-01", "C, 1"): 1000}
    write(tmp_path / "d.csv", "Day,AAA\n1/1/2022,1\n")
    with pytest.raises(Exception, match="no column DATE"):
        tm.load_backtest(spark, str(tmp_path)).collect()


def test_trades_files_need_the_same_header(spark, tmp_path):
    write(tmp_path / "a.csv", HEAD + "A,1/1/2022,,2\n")
    write(tmp_path / "b.csv", "Entry date,System,Exit date,PL\n1/1/2022,A,,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tm.load_trades(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("line, match", [("someday,1", "not a date: someday"), ("1/1/2022,\"1,234.50\"", "not a double: 1,234.50")])
def test_backtest_cells_that_do_not_parse(spark, tmp_path, line, match):
    p = write(tmp_path / "bt.csv", f"Date,A\n2/1/2022,5\n{line}\n")
    with pytest.raises(Exception, match=match):
        tm.load_backtest(spark, p).collect()
    assert tm.load_backtest(spark, p, on_bad="null").count() == 2
    found = tm.load_backtest_checked(spark, p)
    assert [(str(r.date), r.system, r.equity) for r in found.accepted.collect()] == [("2022-01-02", "A", 5.0)]
    (bad,) = found.rejected.collect()
    assert bad.file.endswith("bt.csv") and bad.bad == ["date" if "someday" in line else "equity"] and bad.cells["system"] == "A"
    assert (found.counts["rows"], found.counts["rejected"], found.counts[f"bad_{bad.bad[0]}"]) == (2, 1, 1)


def test_trades_with_rejects_in_one_scan(spark, tmp_path, monkeypatch):
    p = write(tmp_path / "t.csv", HEAD + "A,1/2/2021,2/2/2021,5\nB,soon,later,x\nC,1/2/2021,,\n,,,\n")
    plans = []
    kind = type(spark.range(1))
    kept = kind.observe
    monkeypatch.setattr(kind, "observe", lambda df, *a: plans.append(plan_of(df)) or kept(df, *a))
    found = tm.load_trades_checked(spark, p)
    assert len(plans) == 1 and plans[0].count("FileScan csv") == 1 and "Exchange" not in plans[0]
    assert found.accepted.schema.names == schemas.TRADES.names and {r.system for r in found.accepted.collect()} == {"A", "C", None}
    (bad,) = found.rejected.collect()
    assert bad.bad == ["entry_date", "exit_date", "pl"] and bad.cells["exit_date"] == "later" and bad.cells["ticker"] is None
    assert {k: v for k, v in found.counts.items() if v} == {"rows": 4, "rejected": 1, "bad_entry_date": 1, "bad_exit_date": 1, "bad_pl": 1}
    good = tm.load_trades_checked(spark, write(tmp_path / "g.csv", HEAD + "A,1/2/2021,,5\n"))
    assert good.rejected.count() == 0 and good.accepted.count() == 1
    none = tm.load_trades_checked(spark, write(tmp_path / "n.csv", HEAD))
    assert none.rejected.count() == none.accepted.count() == none.counts["rows"] == 0


def test_backtest(spark, tmp_path):
    p = write(tmp_path / "bt.csv", "Date,abc,x.y\n31/12/2021,100,5\n3/1/2022,101.5,\n")
    got = tm.load_backtest(spark, p)
    assert as_map(got, "date", "system") == {("2021-12-31", "ABC"): 100.0, ("2021-12-31", "X.Y"): 5.0,
                                             ("2022-01-03", "ABC"): 101.5, ("2022-01-03", "X.Y"): None}


FIELDS = "System,Ticker,Entry price,Qty,Exit price,P/L,Allocation,L/S"


def wide_file(path, dates, lines):
    width = FIELDS.count(",") + 1
    head = ["x" + "," * (width * len(dates) - 1), ",".join(d for d in dates for _ in range(width)),
            ",".join([FIELDS] * len(dates))]
    return write(path, "\n".join(head + lines) + "\n")


def test_open_pl_wide(spark, tmp_path):
    blank = "," * 7
    p = wide_file(tmp_path / "o.csv", ["01/02/2021", "2/2/2021"], [
        'A,"T, ""q""",1.5,10,2.5,12.25,0.3,S' + "," + "B,U,1,2,3,4,5,",
        blank + "," + "A,,,,,,,",
        blank + "," + blank,
        "C,V,1,x,,bad,,L" + "," + blank])
    with pytest.raises(Exception, match="not a"):
        tm.load_open_pl(spark, p).collect()
    got = tm.load_open_pl(spark, p, on_bad="null")
    assert got.schema.names == schemas.OPEN_PL.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in schemas.OPEN_PL]
    assert as_map(got, "date", "system") == {
        ("2021-02-01", "A"): ("S", 'T, "q"', 1.5, 10, 2.5, money(12.25)),
        ("2021-02-02", "B"): ("L", "U", 1.0, 2, 3.0, money(4)),
        ("2021-02-02", "A"): ("L", None, 0.0, 0, 0.0, money(0)),
        ("2021-02-01", "C"): ("L", "V", 1.0, 0, 0.0, money(0))}


def test_open_pl_first_of_repeated_blocks_wins(spark, tmp_path):
    p = wide_file(tmp_path / "o.csv", ["01/02/2021", "01/02/2021"], [
        "A,T,1,1,1,5,,L" + "," + "A,T,1,1,1,99,,L", "," * 7 + "," + "B,T,1,1,1,7,,L"])
    assert [(r.system, r.pl) for r in tm.load_open_pl(spark, p).collect()] == [("A", money(5))]


def test_open_pl_many_files_with_their_own_heads(spark, tmp_path):
    wide_file(tmp_path / "a.csv", ["01/02/2021"], ["A,T,1,1,1,5,,L"])
    wide_file(tmp_path / "b.csv", ["03/02/2021", "02/02/2021"], ["A,T,1,1,1,6,,L,A,T,1,1,1,7,,L"])
    assert as_map(tm.load_open_pl(spark, str(tmp_path)).select("date", "pl"), "date") == {
        "2021-02-01": money(5), "2021-02-03": money(6), "2021-02-02": money(7)}
    both = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert tm.load_open_pl(spark, both).count() == 3


def test_open_pl_heads_in_any_split(spark, tmp_path):
    """Header lines longer than a split, and data lines that equal a header line."""
    dates = [f"{d}/01/2021" for d in range(1, 21)]
    line = ",".join(["A,T,1,1,1,5,,L"] * 20)
    p = wide_file(tmp_path / "o.csv", dates, [line] * 5 + ["x" + "," * 159] * 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1024", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = tm.load_open_pl(spark, p)
            assert got.where("system = 'A'").count() == 100 and got.where("system = 'x'").count() == 2
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("old, new, match", [("P/L", "PL", "no field P/L"), ("01/02/2021", "someday", "not a date")])
def test_open_pl_with_a_bad_head(spark, tmp_path, old, new, match):
    p = wide_file(tmp_path / "o.csv", ["01/02/2021"], ["A,T,1,1,1,5,,L"])
    write(tmp_path / "o.csv", (tmp_path / "o.csv").read_text().replace(old, new))
    with pytest.raises(Exception, match=match):
        tm.load_open_pl(spark, p).collect()


def test_read_query_binds_parameters(spark):
    df = spark.createDataFrame([("1/2/2022", 1), ("3/2/2022", 2)], "d string, x int")
    got = tm.read_query(spark, "select d, x, timestamp'2022-05-06 10:00:00' as t from {rows} where x > :least",
                        {"least": 1}, date_cols=["d", "t"], rows=df)
    assert got.first() == (dt.date(2022, 2, 3), 2, dt.date(2022, 5, 6))
    with pytest.raises(Exception, match="not a date: then"):
        tm.read_query(spark, "select 'then' as d", date_cols=["d"]).collect()
    assert tm.read_query(spark, "select 'then' as d", date_cols=["d"], on_bad="null").first() == (None,)
    evil = tm.read_query(spark, "select * from {rows} where d = :d", {"d": "' or 1=1 --"}, rows=df)
    assert evil.count() == 0


def test_write_modes_and_types(spark, tmp_path):
    p, df = str(tmp_path / "t"), spark.createDataFrame([("A", 1)], "system string, x int")
    tm.write_table(df, p, dtypes={"x": "double"}, partition_by=["system"])
    assert dict(tm.read_table(spark, p).dtypes) == {"x": "double", "system": "string"}
    with pytest.raises(Exception, match="already exists"):
        tm.write_table(df, p)
    tm.write_table(df, p, "append", dtypes={"x": "double"}, partition_by=["system"])
    assert tm.read_table(spark, p).count() == 2
    tm.write_table(df, p, "replace")
    assert tm.read_table(spark, p).count() == 1
    with pytest.raises(ValueError, match="if_exists"):
        tm.write_table(df, p, "upsert")


def test_export_csv(spark, tmp_path):
    p = str(tmp_path / "csv")
    tm.export_csv(spark.createDataFrame([("zloty ł", 1.5, None)], "a string, b double, c string"), p)
    text = [f.read_text(encoding="utf-8").splitlines() for f in (tmp_path / "csv").glob("part-*.csv")]
    assert sum(text, [])[:1] == ["a,b,c"] and [r for t in text for r in t[1:]] == ["zloty ł,1.5,"]


def test_exported_bytes_read_back(spark, tmp_path):
    rows = [('say "hi", x', 1), (" pad ", 2), ("", 3), ("a\tb", 4), (None, 5)]
    tm.export_csv(spark.createDataFrame(rows, "a string, b int"), str(tmp_path / "csv"), single_file=True)
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    with open(part, encoding="utf-8", newline="") as f:
        assert sorted(csv.reader(f), key=lambda r: r[1])[:-1] == [[a or "", str(b)] for a, b in rows]


def test_spool_cuts_lineage_in_the_shared_folder(spark):
    df = spark.range(10).groupBy("id").count()
    stored = spool(df, "t")
    assert stored.dtypes == df.dtypes and stored.count() == 10
    assert all(shared_dir(spark).removeprefix("file:") in f for f in stored.inputFiles())
    assert "Exchange" not in plan_of(stored)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_only_the_filled_part_of_a_wide_line_is_parted(spark, tmp_path):
    lines = [("," * 100 + "A,P1,,5" + "," * 130, 100, ["A", "P1", "", "5"]), (" , ,A, b ,", 2, ["A", " b"]), (" , ,", 2, [""]), ("", 0, [""]),
             ('A,, "x, ""y"" " , ,', 0, ["A", "", 'x, "y" ']), (',"",B', 1, ["", "B"]), ("\t,,C", 0, ["\t", "", "C"]), (",é,,", 1, ["é"])]
    part, ahead = files._filled_part(F.col("line"))
    got = spark.createDataFrame([l[:1] for l in lines], "line string").select("line", ahead.alias("ahead"), files._cells(part).alias("cells")).collect()
    assert sorted((r.line, r.ahead, list(r.cells)) for r in got) == sorted(lines)
    fields = ("System", "Ticker", "Entry price", "Qty", "Exit price", "P/L", "L/S")
    heads = [",".join(str(i) for i in range(21)), ",".join(f"{d}/1/2022" for d in (1, 2, 3) for _ in fields), ",".join(fields * 3)]
    p = write(tmp_path / "w.csv", "\n".join([*heads, "," * 7 + "A,P1, ,5,,1.5,S" + "," * 7, "A,,,,,," + "," * 8 + ' "B, 1",,2.5,,,,', "," * 20, "," * 19 + "7,"]) + "\n")
    rows = [(r.date.day, r.system, r.action, r.ticker, r.entry_price, r.qty, r.closing_price, r.pl) for r in tm.load_open_pl(spark, p).collect()]
    assert sorted(rows, key=str) == [(1, "A", "L", None, 0, 0, 0, 0), (2, "A", "S", "P1", 0, 5, 0, money("1.5")),
                                     (3, "B, 1", "L", None, 2.5, 0, 0, 0), (3, None, "L", None, 0, 0, 0, 7)]
