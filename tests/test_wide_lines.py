from helpers import money, plan_of
from pyspark.sql import functions as F, types as T

from tidemark.sources import load_open_pl
from tidemark.sources.files import typed

FIELDS = ("System", "Ticker", "Entry price", "Qty", "Exit price", "P/L", "L/S")


def test_a_wide_line_is_passed_over_once(spark, tmp_path):
    """Both ends are cut off by one pattern, and blocks are looked up by cell, not tried one by one."""
    heads = [",".join(str(i) for i in range(14)), ",".join(d for d in ("3/1/2022", "4/1/2022") for _ in FIELDS), ",".join(FIELDS * 2)]
    (tmp_path / "open.csv").write_text("\n".join([*heads, "," * 7 + "A,P1,,5,,1.5,S"]) + "\n")
    plan = plan_of(load_open_pl(spark, str(tmp_path / "open.csv")))
    assert plan.count("regexp_extract(value#") == 1 and "reverse(" not in plan
    assert "filter(blocks#" not in plan


def test_text_is_parsed_once(spark):
    plan = plan_of(spark.createDataFrame([("1/2/2022",)], "t string").select(typed(F.col("t"), T.DateType(), "raise").alias("d")))
    assert plan.count("d/M/yyyy") == 1


def test_blocks_that_interleave_or_lie_apart(spark, tmp_path):
    """Cells of two dates take turns, columns without a field lie between blocks, lines fill several blocks or cells behind the last."""
    days = [d for _ in FIELDS for d in ("3/1/2022", "4/1/2022")] + ["", ""] + ["5/1/2022"] * 7
    names = [f for f in FIELDS for _ in "12"] + ["Note", ""] + list(FIELDS)
    cells = ["A", "B", "P1", "P2", "", "", "5", "6", "", "", "1.5", "2.5", "S", ""]
    lines = [cells + [""] * 9, [""] * 16 + ["C", "", "", "", "", "7", ""], cells + ["x", "", "D", "", "", "", "", "9", "L"], [""] * 14 + ["y"] + [""] * 8,
             [""] * 23 + ["z", ""], [" "] * 23]
    heads = [[str(i) for i in range(23)], days, names]
    (tmp_path / "open.csv").write_text("\n".join(",".join(r) for r in heads + lines) + "\n")
    got = [(r.date.day, r.system, r.ticker, r.qty, r.pl, r.action) for r in load_open_pl(spark, str(tmp_path / "open.csv")).collect()]
    one, two = (3, "A", "P1", 5, money("1.5"), "S"), (4, "B", "P2", 6, money("2.5"), "L")
    late = [(5, system, None, 0, money(pl), "L") for system, pl in (("C", "7"), ("D", "9"))]
    assert sorted(got, key=str) == sorted([one, one, two, two, *late], key=str)
