"""Explicit schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BARS = _schema(date=T.DateType(), open=T.DoubleType(), high=T.DoubleType(), low=T.DoubleType(),
               close=T.DoubleType(), month=T.IntegerType(), year=T.IntegerType())

TRADES = _schema(trade_id=T.LongType(), system=T.StringType(), action=T.StringType(), ticker=T.StringType(),
                 entry_date=T.DateType(), entry_price=T.DoubleType(), quantity=T.LongType(), commission=MONEY,
                 exit_date=T.DateType(), exit_price=T.DoubleType(), pl=MONEY)

OPEN_PL = _schema(date=T.DateType(), system=T.StringType(), action=T.StringType(), ticker=T.StringType(),
                  entry_price=T.DoubleType(), qty=T.LongType(), closing_price=T.DoubleType(), pl=MONEY)

BACKTEST = _schema(date=T.DateType(), system=T.StringType(), equity=T.DoubleType())

CALENDAR = _schema(date=T.DateType(), month=T.IntegerType(), year=T.IntegerType())

ALLOCATIONS = _schema(system=T.StringType(), alloc=T.DoubleType())

CURVES = _schema(system=T.StringType(), run=T.IntegerType(), step=T.IntegerType(), equity=T.DoubleType())

EPISODES = _schema(system=T.StringType(), run=T.IntegerType(), equity_high=T.DoubleType(),
                   pct=T.DoubleType(), days=T.LongType())
