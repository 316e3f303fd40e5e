"""The engine's input tables, derived from an order-and-lineitem schema.

A lineitem is a position of the "system" named by its order's priority: closed if its line status
is F, open if it is O. Orders give the price bars. Operands are cast to decimal before they are
multiplied, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from . import schemas
from .functions.stats import running
from .sources.shared import spool

START_CAPITAL = 1_000_000
# The five order priorities.
SYSTEMS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


# Schemas seen so far: looking one up is a job of its own, and a query scans a table several times.
_SCHEMAS: dict[str, StructType] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _positions(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """Lineitems of one status with their order's date and priority."""
    items = _table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount, tax = F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        F.col("o_orderpriority").alias("system"),
        F.when(F.col("l_returnflag") == "R", "S").otherwise("L").alias("action"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("l_shipdate").cast("date").alias("ship_date"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (price * tax).cast(schemas.MONEY).alias("commission"),
        (price * (discount - tax)).cast(schemas.MONEY).alias("pl"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed positions."""
    return _positions(spark, sf_dir, "F").select(
        "trade_id", "system", "action", "ticker", F.least("order_date", "ship_date").alias("entry_date"),
        F.col("unit_price").alias("entry_price"), "quantity", "commission",
        F.greatest("order_date", "ship_date").alias("exit_date"), "pl")


def open_pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open positions, marked on their ship date."""
    return _positions(spark, sf_dir, "O").select(
        F.col("ship_date").alias("date"), "system", "action", "ticker", F.col("quantity").alias("qty"), "pl")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price bar per order date."""
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return (_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
            .agg(F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"),
                 F.min(price).alias("low"), F.max_by(price, "o_orderkey").alias("close")))


def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running closed profit per system on top of the start capital."""
    daily = trades(spark, sf_dir).groupBy("system", F.col("exit_date").alias("date")).agg(F.sum("pl").alias("pl"))
    so_far = F.sum("pl").over(running(W.partitionBy("system").orderBy("date")))
    return daily.select("date", "system", (F.lit(START_CAPITAL) + so_far).cast("double").alias("equity"))


# Files in the layouts that the loaders read.

def write_trades_csv(rows: DataFrame, path: str, spoilt: bool = False) -> None:
    """Trade log file with day-first dates; ``spoilt`` files have some exit dates and profits that do not parse."""
    def day(c: str):
        return F.date_format(c, "d/M/yyyy")

    if spoilt:
        rows = rows.withColumns({"exit_date": F.when(F.col("trade_id") % 13 == 0, "someday").otherwise(day("exit_date")),
                                 "pl": F.when(F.col("trade_id") % 17 == 0, F.concat(F.col("pl").cast("string"), F.lit(",0 USD"))).otherwise(F.col("pl").cast("string"))})
    rows.select(F.col("trade_id").alias("Trade ID"), F.col("system").alias("System"), F.col("action").alias("Action"),
                F.col("ticker").alias("Ticker"), day("entry_date").alias("Entry date"),
                F.col("entry_price").alias("Entry price"), F.col("quantity").alias("Quantity"),
                F.col("commission").alias("Commission"), (F.col("exit_date") if spoilt else day("exit_date")).alias(" Exit date "),
                F.lit(None).cast("string").alias("Exit price"), F.col("pl").alias("PL"),
                ).write.option("header", True).csv(path)


def write_backtest_csv(rows: DataFrame, path: str, systems: tuple[str, ...] = SYSTEMS, spoilt: bool = False) -> None:
    """Backtest file: one column per system, in the given order; ``spoilt`` files spell some numbers in a way that does not parse."""
    wide = rows.groupBy("date").pivot("system", list(systems)).agg(F.max("equity"))
    cells = [F.col(f"`{s}`") for s in systems]
    if spoilt:
        cells = [F.when(F.dayofmonth("date") == 13, F.concat(F.format_number(c, 1), F.lit("?"))).otherwise(c.cast("string")).alias(s) for c, s in zip(cells, systems)]
    wide.select(F.date_format("date", "dd/MM/yyyy").alias("Date"), *cells).write.option("header", True).csv(path)


def write_bars_csv(rows: DataFrame, path: str, blanks: bool = False) -> None:
    """Price file; with ``blanks`` the bars of every tenth day of a month lack a cell."""
    cells = {c: F.col(c) for c in ("date", "open", "high", "low", "close")}
    if blanks:
        cells["high"] = F.when(F.dayofmonth("date") % 10 != 0, F.col("high"))
    rows.select(*[v.alias(c.upper()) for c, v in cells.items()]).write.option("header", True).csv(path)


def write_open_pl_wide(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Wide open-position files: per month, three header lines and one block of cells per day.

    A line fills the block of its own date and leaves the others blank. A month with many positions is
    spread over as many files as its row count asks for, by the unique ``position_id``, so that neither a
    busy day nor many copies of a row end up in one task. Lines are dealt out and sorted by their filled cells alone, and get
    their blank ones as they are written.
    """
    # Field names of one block, in file order.
    fields = {"System": "system", "Ticker": "ticker", "Entry price": None, "Qty": "qty", "Exit price": None,
              "P/L": "pl", "Allocation": None, "L/S": "action"}
    width = len(fields)
    rows = rows.withColumn("month", F.trunc("date", "month"))
    months = spool(rows.groupBy("month").agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("parts")), "months")

    cells = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
                               for c in fields.values()])
    lines = rows.join(months, "month").select(
        "month", F.pmod(F.xxhash64("position_id"), "parts").alias("part"), F.lit(4).alias("line_no"),
        F.dayofmonth("date").alias("day"), cells.alias("cells"))

    days = F.sequence("month", F.last_day("month"))
    numbers = F.transform(F.sequence(F.lit(1), F.size(days) * width), lambda i: i.cast("string"))
    dates = F.flatten(F.transform(days, lambda d: F.array_repeat(F.date_format(d, "dd/MM/yyyy"), width)))
    names = F.flatten(F.array_repeat(F.array(*[F.lit(f) for f in fields]), F.size(days)))
    heads = (months.select("month", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
             .select("month", "part", F.posexplode(F.array(numbers, dates, names)).alias("line_no", "cells"))
             .select("month", "part", "line_no", F.lit(0).alias("day"), F.concat_ws(",", "cells").alias("cells")))
    before = F.repeat(F.lit(","), (F.col("day") - 1) * width)
    after = F.repeat(F.lit(","), (F.dayofmonth(F.last_day("month")) - F.col("day")) * width)
    value = F.when(F.col("line_no") < 4, F.col("cells")).otherwise(F.concat(before, "cells", after))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.unionByName(heads).repartition(partitions, "month", "part").sortWithinPartitions("month", "part", "line_no")
     .select("month", "part", value.alias("value")).write.partitionBy("month", "part").text(path))


def open_positions_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``open_pl`` with the lineitem's own id."""
    return _positions(spark, sf_dir, "O").select(
        F.col("trade_id").alias("position_id"), F.col("ship_date").alias("date"), "system", "action", "ticker",
        F.col("quantity").alias("qty"), "pl")
