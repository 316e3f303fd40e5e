"""Name clean-up and number formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_name(name: str) -> str:
    """Trimmed, upper-case column name as found in source files."""
    return name.strip().strip("﻿").upper()


def trunc_2dp(value: Column) -> Column:
    """Cut (do not round) after two decimals."""
    exact = F.abs(value.cast("double")).cast("decimal(38,18)")
    return F.signum(value.cast("double")) * F.floor(exact, F.lit(2)).cast("double")


def format_2dp(value: Column) -> Column:
    """Text with two decimals, half away from zero."""
    return value.cast("decimal(38,12)").cast("decimal(38,2)").cast("string")
