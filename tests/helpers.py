"""Small frames for the tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def money(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.0001"))


def trades(spark, *rows):
    """Rows of (exit_date or None, system, pl), optionally with an entry date."""
    full = [(i, r[1], "L", "T", day(r[3]) if len(r) > 3 else day("2020-01-01"), 1.0, 1, money(0),
             day(r[0]) if r[0] else None, 1.0, money(r[2])) for i, r in enumerate(rows)]
    from tidemark.schemas import TRADES
    return spark.createDataFrame(full, TRADES)


def open_pl(spark, *rows):
    """Rows of (date, system, pl)."""
    from tidemark.schemas import OPEN_PL
    return spark.createDataFrame([(day(d), s, "L", "T", 1.0, 1, 1.0, money(p)) for d, s, p in rows], OPEN_PL)


def calendar(spark, *dates):
    return spark.createDataFrame([(day(d),) for d in dates], "date date")


def bars(spark, *rows):
    """Rows of (date, close)."""
    return spark.createDataFrame([(day(d), c, c, c, c) for d, c in rows],
                                 "date date, open double, high double, low double, close double")


def series(spark, value, *rows):
    """Rows of (date, system, value)."""
    return spark.createDataFrame([(day(d), s, v) for d, s, v in rows], f"date date, system string, {value} double")


def as_map(df, *keys):
    """Key columns -> the one remaining column, or a tuple of them."""
    rest = [c for c in df.columns if c not in keys]
    out = {}
    for r in df.collect():
        k = tuple(str(r[c]) for c in keys)
        out[k[0] if len(k) == 1 else k] = r[rest[0]] if len(rest) == 1 else tuple(r[c] for c in rest)
    return out


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
