"""Date expressions: month ends, named periods, day-first parsing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

# Period label -> months back from the as-of date.
# "ytd" goes back as many months as the as-of month has, "all" uses a floor.
PERIODS = ("current_month", "2_months", "3_months", "ytd", "all")
_MONTHS_BACK = {"current_month": 1, "2_months": 2, "3_months": 3}

ALL_FLOOR = dt.date(2000, 1, 1)


def month_end(date: Column, months: int | Column = 0) -> Column:
    """Last day of the month that lies ``months`` away from ``date``."""
    return F.last_day(F.add_months(date, months))


def month_key(date: Column) -> Column:
    """``yyyy-MM`` key, which sorts in calendar order."""
    return F.date_format(date, "yyyy-MM")


def period_start(as_of: Column, period: str, all_floor: dt.date = ALL_FLOOR) -> Column:
    """Exclusive lower bound of a named period that ends on ``as_of``."""
    if period == "all":
        return F.lit(all_floor)
    if period == "ytd":
        return month_end(as_of, -F.month(as_of))
    if period in _MONTHS_BACK:
        return month_end(as_of, -_MONTHS_BACK[period])
    raise ValueError(f"unknown period {period!r}; choose one of {PERIODS}")


def range_start(date_from: dt.date | str, date_to: dt.date, all_floor: dt.date = ALL_FLOOR) -> dt.date | Column:
    """Exclusive lower bound of a range that starts on a date or is a named period ending on ``date_to``."""
    return period_start(F.lit(date_to), date_from, all_floor) if isinstance(date_from, str) else date_from


def periods_array(as_of: Column, all_floor: dt.date = ALL_FLOOR) -> Column:
    """All named periods as an array of ``(period, date_from)``."""
    return F.array(*[
        F.struct(F.lit(p).alias("period"), period_start(as_of, p, all_floor).alias("date_from"))
        for p in PERIODS
    ])


def parse_day_first(text: Column) -> Column:
    """Parse day, month, year parted by ``/``, ``-`` or ``.``, the year of four or two digits, or ISO text.

    Two digits are years from 2000 on. Anything else, blanks included, is NULL.
    """
    text = F.trim(text)
    slashed = F.replace(F.replace(text, F.lit("-"), F.lit("/")), F.lit("."), F.lit("/"))  # cheaper than a pattern
    return F.coalesce(F.try_to_date(slashed, "d/M/yyyy"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
                      F.try_to_date(slashed, "d/M/yy"))
