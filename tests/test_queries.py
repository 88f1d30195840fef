"""Every registered query beside its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from fieldlab.queries.registry import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    import duckdb
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(entry._registered.queries()))
def test_query_agrees_with_sql(spark, con, name):
    from check import compare
    result = compare(spark, con, name, FOLDER)
    assert not result.startswith("FAIL"), result


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
