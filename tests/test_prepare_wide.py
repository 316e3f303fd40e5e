import datetime as dt

from helpers import money, plan_of
from tidemark.plans import prepare
from tidemark.sources import load_open_pl


def test_stored_open_positions_part_few_cells_of_a_line(spark, tmp_path):
    """``prepare`` loads its positions through ``load_open_pl``, which must not part the blank cells of a line."""
    for name, text in {"bars": "Date,Open,High,Low,Close\n2022-01-03,1,2,1,2\n2022-01-04,1,2,1,2\n", "trades": "System,Entry date,Exit date,PL\nA,1/1/2022,2/1/2022,5\n",
                       "backtest": "Date,A\n1/1/2022,100\n2/1/2022,110\n3/1/2022,90\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    fields = ("System", "Ticker", "Entry price", "Qty", "Exit price", "P/L", "L/S")
    heads = [",".join(str(i) for i in range(7 * 31)), ",".join(f"{d}/1/2022" for d in range(1, 32) for _ in fields), ",".join(fields * 31)]
    lines = ["," * (7 * d) + "A,P1,,5,,1.5,S" + "," * (7 * (30 - d)) for d in range(31)]
    (tmp_path / "open_pl.csv").write_text("\n".join([*heads, *lines]) + "\n")
    inputs = {n: str(tmp_path / f"{n}.csv") for n in ("bars", "trades", "open_pl", "backtest")}
    stored = prepare(spark, inputs, str(tmp_path / "out"), dt.date(2022, 1, 1), runs=2)
    got = sorted(stored["open_pl"].collect(), key=lambda r: r.date)
    assert [(r.date.day, r.system, r.action, r.ticker, r.qty, r.pl) for r in got] == [(d, "A", "S", "P1", 5, money("1.5")) for d in range(1, 32)]
    assert "split(value#" not in plan_of(load_open_pl(spark, inputs["open_pl"]))
