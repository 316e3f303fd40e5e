"""Loaders for the input files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window as W, functions as F, types as T

from .. import schemas
from ..functions.dates import parse_day_first
from ..functions.text import clean_name
from .shared import fresh_path, spool

# Field names of the input files, trimmed and upper-cased -> column.
_TRADE_FIELDS = {
    "TRADE ID": "trade_id", "SYSTEM": "system", "ACTION": "action", "TICKER": "ticker",
    "ENTRY DATE": "entry_date", "ENTRY PRICE": "entry_price", "QUANTITY": "quantity",
    "COMMISSION": "commission", "EXIT DATE": "exit_date", "EXIT PRICE": "exit_price", "PL": "pl",
}
_OPEN_FIELDS = {
    "SYSTEM": "system", "L/S": "action", "TICKER": "ticker", "ENTRY PRICE": "entry_price",
    "QTY": "qty", "EXIT PRICE": "closing_price", "P/L": "pl",
}
_DEFAULT_ACTION = "L"

#: Fields of a trades file that may be missing; they load as NULL.
OPTIONAL_TRADE_FIELDS = ("TRADE ID", "ACTION", "TICKER", "ENTRY PRICE", "QUANTITY", "COMMISSION", "EXIT PRICE")


def _read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text, names trimmed and upper-cased.

    A quote inside a quoted cell is doubled. Files of one folder whose headers differ are an error.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)
    return raw.toDF(*[clean_name(c) for c in raw.columns])


def typed(text: Column, wanted: T.DataType, on_bad: str = "null") -> Column:
    """Text as a wanted type. Blank text is NULL; other text that does not parse is NULL or an error."""
    if on_bad not in ("raise", "null"):
        raise ValueError(f"on_bad must be 'raise' or 'null', not {on_bad!r}")
    parsed = _parsed(text, wanted)
    if on_bad == "null":
        return parsed
    # only text that did not parse is looked at again: a second parse would cost as much as the first
    wrong = F.raise_error(F.concat(F.lit(f"not a {wanted.simpleString()}: "), text)).cast(wanted)
    return F.coalesce(parsed, F.when(F.trim(text) != "", wrong))


def _parsed(text: Column, wanted: T.DataType) -> Column:
    if isinstance(wanted, T.DateType):
        return parse_day_first(text)
    if isinstance(wanted, T.StringType):
        return text
    text = F.when(F.trim(text) != "", text)  # a cast that fails on a blank cell costs more than all else of its row
    if isinstance(wanted, T.LongType):
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return text.try_cast(wanted)


def load_bars(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Daily bars: date, open, high, low, close, month, year.

    Rows with any blank cell are dropped. An adjusted close takes the place of the close. A
    timestamp counts with its own calendar date, whatever its offset.
    """
    if format == "csv":
        raw = _read_text_columns(spark, path)
    else:
        raw = spark.read.format(format).load(path)
        raw = raw.toDF(*[clean_name(c) for c in raw.columns])
    raw = raw.dropna("any")
    close = F.col("`ADJ CLOSE`") if "ADJ CLOSE" in raw.columns else F.col("CLOSE")
    prices = {"open": F.col("OPEN"), "high": F.col("HIGH"), "low": F.col("LOW"), "close": close}
    date = F.to_date(F.substring(F.col("DATE").cast("string"), 1, 10), "yyyy-MM-dd")
    return (raw.select(date.alias("date"), *[p.cast("double").alias(n) for n, p in prices.items()])
            .withColumns({"month": F.month("date"), "year": F.year("date")}))


def load_trades(spark: SparkSession, path: str, on_bad: str = "raise") -> DataFrame:
    """Executed trades with day-first dates. A blank exit date stays NULL: the trade is still open.

    A missing field is an error unless it is one of ``OPTIONAL_TRADE_FIELDS``. Dates and numbers that do
    not parse are an error, or NULL with ``on_bad="null"``.
    """
    raw = _read_text_columns(spark, path)
    source = _trade_columns(raw, path)
    return raw.select(*[typed(source[f.name], f.dataType, on_bad).alias(f.name) for f in schemas.TRADES])


def _trade_columns(raw: DataFrame, path: str) -> dict[str, Column]:
    """The text of each column of the trades table; NULL for an optional field that the file lacks."""
    missing = [f for f in _TRADE_FIELDS if f not in raw.columns and f not in OPTIONAL_TRADE_FIELDS]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return {name: F.col(f"`{field}`") if field in raw.columns else F.lit(None).cast("string") for field, name in _TRADE_FIELDS.items()}


def stored_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files, stored once: value, file, block_start, place.

    ``place`` numbers the lines in the order of their split and is unique. It is written along with the line by the one scan that
    reads the files, so all later jobs see the same places, however they are cut into tasks.
    """
    return spool(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                              F.col("_metadata.file_block_start").alias("block_start"),
                                              F.monotonically_increasing_id().alias("place")), "text-lines")


def _with_header(lines: DataFrame) -> DataFrame:
    """Each data line's cells next to the names in its own file's header: file, names, cells. Blank lines are left out.

    The header is the first line of a file that is not blank; each task offers one line per file ahead of the shuffle.
    """
    filled = lines.where(F.trim("value") != "")
    heads = filled.groupBy("file").agg(F.min(F.struct("block_start", "place", "value")).alias("head"))
    names = F.transform(_cells(F.col("head.value")), lambda c: F.upper(F.regexp_replace(c, r"^[\s\ufeff]+|[\s\ufeff]+$", "")))
    heads = heads.select("file", F.col("head.place").alias("header_place"), names.alias("names"))
    return filled.join(heads, "file").where("place <> header_place").select("file", "names", _cells(F.col("value")).alias("cells"))


def _backtest_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line and system of the line's file, as text: file, date, system, equity."""
    rows = _with_header(stored_lines(spark, path))
    at = F.array_position("names", "DATE").cast("int")
    missing = F.raise_error(F.concat(F.lit("no column DATE in "), F.col("file"))).cast("string")
    date = F.when(at == 0, missing).otherwise(F.get("cells", at - 1))
    systems = F.filter(F.arrays_zip("names", "cells"), lambda c: c["names"] != "DATE")
    return (rows.select("file", date.alias("date"), F.inline(systems))
            .select("file", "date", F.col("names").alias("system"), F.trim("cells").alias("equity")))


def load_backtest(spark: SparkSession, path: str | list[str], on_bad: str = "raise") -> DataFrame:
    """Backtest equity, one column per system in the file, as rows: date, system, equity.

    Each file is read by its own header, so files of one load may hold other systems, or the same in another order. A blank
    cell is NULL; a date or number that does not parse is an error, or NULL with ``on_bad="null"``.
    """
    cells = _backtest_cells(spark, path)
    return cells.select(typed(F.col("date"), T.DateType(), on_bad).alias("date"), "system",
                        typed(F.col("equity"), T.DoubleType(), on_bad).alias("equity"))


class Checked(NamedTuple):
    """A load that sets bad rows aside: the good rows, the bad ones, and the counts seen by the scan that parted them.

    ``rejected`` has file, bad (names of the columns that do not parse) and cells (column -> text). ``counts`` has rows,
    rejected, and bad_<column> for each column.
    """
    accepted: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def _check(texts: DataFrame, wanted: T.StructType, label: str) -> Checked:
    """Part rows of text cells (and ``file``) into those whose cells all parse and the others, in one pass.

    Both go into one stored table with a folder for each, and the counts are observed while it is written. Blank cells
    are NULL and not bad.
    """
    parsed = {f.name: _parsed(F.col(f.name), f.dataType) for f in wanted}
    wrong = {n: F.coalesce(c.isNull() & (F.trim(n) != ""), F.lit(False)) for n, c in parsed.items()}
    cells = F.create_map(*[x for n in parsed for x in (F.lit(n), F.col(n))])
    rows = texts.select("file", F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in wrong.items()])).alias("bad"),
                        cells.alias("cells"), F.struct(*[c.alias(n) for n, c in parsed.items()]).alias("row"))
    rows = rows.withColumn("is_rejected", F.size("bad") > 0)
    rows = rows.withColumns({"cells": F.when(F.col("is_rejected"), F.col("cells")), "row": F.when(~F.col("is_rejected"), F.col("row"))})
    seen = Observation(label)
    counted = [F.count_if(F.array_contains("bad", n)).alias(f"bad_{n}") for n in parsed]
    path = fresh_path(texts.sparkSession, label)
    (rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("is_rejected").alias("rejected"), *counted)
     .write.partitionBy("is_rejected").parquet(path))
    stored = texts.sparkSession.read.schema(rows.schema).parquet(path)
    return Checked(stored.where("not is_rejected").select("row.*"), stored.where("is_rejected").select("file", "bad", "cells"), seen.get)


def load_backtest_checked(spark: SparkSession, path: str | list[str]) -> Checked:
    """``load_backtest`` with the cells that do not parse set aside and counted, one row per cell."""
    return _check(_backtest_cells(spark, path), schemas.BACKTEST, "backtest-checked")


def load_trades_checked(spark: SparkSession, path: str) -> Checked:
    """``load_trades`` with the lines that do not parse set aside and counted."""
    raw = _read_text_columns(spark, path)
    source = _trade_columns(raw, path)
    return _check(raw.select(F.input_file_name().alias("file"), *[c.alias(n) for n, c in source.items()]), schemas.TRADES, "trades-checked")


def backtest_systems(backtest: DataFrame) -> DataFrame:
    """Upper-cased distinct systems of the backtest table."""
    return backtest.select(F.upper("system").alias("system")).distinct()


def _cells(line: Column) -> Column:
    """Cells of one CSV line as an array; only lines with quotes need the pattern."""
    pattern = r'\s*("(?:[^"]|"")*+"|[^,]*+)\s*,'

    def unquoted(cell: Column) -> Column:
        inner = F.replace(F.regexp_replace(cell, r'^"|"$', ""), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(cell, F.lit('"')), inner).otherwise(cell)

    quoted = F.transform(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(pattern), F.lit(1)), unquoted)
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def _filled_part(line: Column) -> tuple[Column, Column]:
    """The line without the blank cells at its two ends, and the number of those left out ahead of it.

    One pattern cuts off both ends: a pass over a wide line costs more than all its filled cells.
    """
    part = F.regexp_extract(line, r"(?s)^[ ,]*+(.*[^ ,])?", 1)
    return part, _cells_ahead(line, part)


def _cells_ahead(line: Column, part: Column) -> Column:
    ahead = F.when(part == "", line).otherwise(F.substring(line, F.lit(1), F.instr(line, part) - 1))
    return F.length(F.replace(ahead, F.lit(" "), F.lit("")))


def _heads(lines: DataFrame) -> DataFrame:
    """The three header lines of each file, and their places: file, head_1, head_2, head_3, places.

    They may lie in any of the file's splits: each split offers its first three lines, and the first three of
    all by (split, place) are taken. Every task keeps three lines per split ahead of the shuffle.
    """
    in_split = W.partitionBy("file", "block_start").orderBy("place")
    in_file = W.partitionBy("file").orderBy("block_start", "place")
    return (lines.withColumn("split_no", F.row_number().over(in_split)).where("split_no <= 3")
            .withColumn("line_no", F.row_number().over(in_file)).where("line_no <= 3")
            .groupBy("file").agg(F.collect_list("place").alias("places"),
                                 *[F.max(F.when(F.col("line_no") == n, F.col("value"))).alias(f"head_{n}") for n in (1, 2, 3)]))


def _blocks(heads: DataFrame) -> DataFrame:
    """One row per file: the places of its header lines, and its date blocks with the cell number of each field.

    Line 1 is a plain header, line 2 holds the date of every column, line 3 its field. A date may occur twice; the
    first cell of each (date, field) counts. A date that does not parse, a block that lacks a field and a file
    without blocks are errors. Blocks lie in the order of their first cells; ``from_block`` holds for each cell the first block
    that ends there or later, ``to_block`` the number of blocks that begin there or earlier.
    """
    columns = heads.select("file", "places", F.posexplode_outer(F.arrays_zip(
        _cells(F.col("head_2")).alias("day"), _cells(F.col("head_3")).alias("field"))).alias("cell", "head"))
    field = F.upper(F.trim("head.field"))
    titled = columns.select("file", "places", "cell", field.alias("field"), F.col("head.day").alias("day")).where(
        F.col("field").isin(list(_OPEN_FIELDS)) | F.col("field").isNull())
    titled = titled.withColumn("date", typed(F.col("day"), T.DateType(), "raise"))
    placed = [F.min(F.when(F.col("field") == f, F.col("cell"))).alias(f"at_{n}") for f, n in _OPEN_FIELDS.items()]
    dated = titled.groupBy("file", "places", "date").agg(*placed)
    for f, n in _OPEN_FIELDS.items():
        lacks = F.col("date").isNotNull() & F.col(f"at_{n}").isNull()
        message = F.concat(F.lit(f"no field {f} for "), F.col("date").cast("string"), F.lit(" in "), F.col("file"))
        dated = dated.withColumn(f"at_{n}", F.when(lacks, F.raise_error(message).cast("int")).otherwise(F.col(f"at_{n}")))
    ats = [F.col(f"at_{n}") for n in _OPEN_FIELDS.values()]
    dated = dated.withColumn("first", F.when(F.col("date").isNotNull(), F.least(*ats)))
    dated = dated.withColumn("reach", F.max(F.when(F.col("date").isNotNull(), F.greatest(*ats))).over(W.partitionBy("file").orderBy("first")))
    block = F.struct("first", "reach", "date", *ats)
    found = dated.groupBy("file", "places").agg(F.array_sort(F.collect_list(F.when(F.col("date").isNotNull(), block))).alias("blocks"))
    none = F.raise_error(F.concat(F.lit("no date block in "), F.col("file"))).cast(found.schema["blocks"].dataType)
    found = found.withColumn("blocks", F.when(F.size("blocks") == 0, none).otherwise(F.col("blocks")))
    cells = F.element_at("blocks", -1)["reach"] + 1
    ends = F.transform("blocks", lambda b, i: F.array_repeat(i, b["reach"] - F.coalesce(F.get("blocks", i - 1)["reach"], F.lit(-1))))
    begins = F.transform("blocks", lambda b, i: F.array_repeat(i + 1, F.coalesce(F.get("blocks", i + 1)["first"], cells) - b["first"]))
    return found.select("file", "places", "blocks", F.flatten(ends).alias("from_block"),
                        F.concat(F.array_repeat(F.lit(0), F.get("blocks", F.lit(0))["first"]), F.flatten(begins)).alias("to_block"))


def load_open_pl(spark: SparkSession, path: str | list[str], on_bad: str = "raise") -> DataFrame:
    """Daily open positions from wide files, one row per position and date.

    Works on any number of files, each with its own three header lines and date blocks. A file is one small row
    with an array of blocks, joined to its lines, which takes the place of a loop over files and dates; blank
    blocks of a line are dropped before the others become rows. A line mostly fills few of its blocks: only its cells from the
    first to the last that is not blank are parted, and only the blocks that lie there are looked up. The header lines are
    left out by their stored place.
    Blank numbers become 0 and a blank action becomes long; blank text stays NULL. Numbers that do not parse are an
    error, or count as blank with ``on_bad="null"``.
    """
    names = list(_OPEN_FIELDS.values())
    lines = stored_lines(spark, path)
    parsed = (lines.select("file", "place", "value", _filled_part(F.col("value"))[0].alias("part"))
              .select("file", "place", _cells_ahead(F.col("value"), F.col("part")).alias("ahead"), _cells(F.col("part")).alias("cells")))
    blocks = spool(_blocks(_heads(lines)), "open-pl-blocks")
    first = F.get("from_block", F.col("ahead"))
    beyond = F.get("to_block", F.least(F.col("ahead") + F.size("cells"), F.size("to_block")) - 1)
    met = F.slice("blocks", first + 1, F.greatest(beyond - first, F.lit(0)))
    positions = (parsed.join(blocks, "file").where(~F.array_contains("places", F.col("place")))
                 .select("ahead", "cells", F.inline(met)))
    cells = {n: F.coalesce(F.trim(F.get("cells", F.col(f"at_{n}") - F.col("ahead"))), F.lit("")) for n in names}
    raw = positions.select("date", *[c.alias(n) for n, c in cells.items()]).where(F.concat(*names) != "")
    text = {n: F.nullif(F.col(n), F.lit("")) for n in ("system", "action", "ticker")}
    raw = raw.select("date", *[text.get(n, F.col(n)).alias(n) for n in names])
    defaults = {"action": F.lit(_DEFAULT_ACTION), "entry_price": F.lit(0.0), "qty": F.lit(0),
                "closing_price": F.lit(0.0), "pl": F.lit(0).cast(schemas.MONEY)}
    columns = {f.name: typed(F.col(f.name), f.dataType, on_bad) for f in schemas.OPEN_PL if f.name != "date"}
    return raw.select("date", *[(F.coalesce(c, defaults[n]) if n in defaults else c).alias(n)
                                for n, c in columns.items()])
