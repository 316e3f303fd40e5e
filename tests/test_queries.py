"""Every registered query against its DuckDB twin, on the smallest driver data."""

import os

import pytest

import __spark_entry__ as entry
from compare import duck, duck_rows, spark_rows

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_each_query_has_a_twin():
    assert {f.__name__ for f in entry._QUERIES} == entry.oracle_sql().keys() - entry.LLM_QUERIES.keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "p_ret_pct", "bench_ret_pct"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    got = spark_rows(entry.queries()[name](spark, SF_DIR))
    want = duck_rows(con, entry.oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_wide_files_of_any_size(spark, con):
    from tidemark import fixtures as fx, load_open_pl
    from tidemark.sources import fresh_path
    path = fresh_path(spark, "open-pl-wide")
    fx.write_open_pl_wide(fx.open_positions_with_id(spark, SF_DIR), path, rows_per_file=20)
    assert spark_rows(load_open_pl(spark, path)) == duck_rows(con, entry.oracle_sql()["open_pl_from_wide"])
