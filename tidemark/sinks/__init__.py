"""Writing results: Parquet tables and CSV exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .versions import live_versions, publish, read_published

__all__ = ["export_csv", "live_versions", "publish", "read_published", "write_table"]

# What to do with an existing table -> Spark save mode.
_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
#: Replaces the folders that the new rows have and leaves the others.
_PARTS = "replace_parts"


def write_table(df: DataFrame, path: str, if_exists: str = "fail", dtypes: Mapping[str, str] | None = None,
                partition_by: Sequence[str] = ()) -> None:
    """Write a table; ``dtypes`` overrides column types, ``partition_by`` lays out folders.

    ``if_exists="replace_parts"`` replaces only those folders for which there are new rows. A reader may meet the table in
    between; see ``publish`` for tables that are read while they are rebuilt.
    """
    if if_exists not in (*_MODES, _PARTS):
        raise ValueError(f"if_exists must be one of {(*_MODES, _PARTS)}, not {if_exists!r}")
    if if_exists == _PARTS and not partition_by:
        raise ValueError(f"{_PARTS!r} needs partition_by")
    typed = df.withColumns({c: F.col(c).cast(t) for c, t in (dtypes or {}).items()})
    writer = typed.write.mode(_MODES.get(if_exists, "overwrite")).partitionBy(*partition_by)
    if if_exists == _PARTS:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, if_exists: str = "fail", single_file: bool = False) -> None:
    """Standard UTF-8 CSV: a header line in every part file, quotes doubled, blanks kept, NULL and empty text empty.

    ``single_file`` writes one part, for small results only.
    """
    out = df.coalesce(1) if single_file else df
    (out.write.mode(_MODES[if_exists]).option("header", True).option("encoding", "UTF-8").option("escape", '"')
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
