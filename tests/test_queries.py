"""Every registered query runs and, where SQL expresses it, gives the rows that DuckDB gives."""

import os

import pytest

import __spark_entry__ as entry
from tests.against_duckdb import from_duckdb, from_spark

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_same_rows_as_sql(spark, name):
    columns, rows = from_spark(QUERIES[name](spark, SF_DIR))
    wanted_columns, wanted = from_duckdb(SQL[name], SF_DIR)
    assert columns == wanted_columns
    assert len(rows) == len(wanted)
    different = [(a, b) for a, b in zip(rows, wanted, strict=True) if a != b]
    assert not different, different[:3]


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_runs(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0 and df.columns


def test_entry(spark):
    assert set(entry.entry(spark).columns) >= {"file_id", "word", "frequency"}
