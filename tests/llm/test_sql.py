"""Corpus queries beside their SQL on the smallest test tables."""

import os

import pytest

from fieldlab.llm.registry import SQL
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


@pytest.mark.parametrize("name", list(SQL))
def test_query_agrees_with_sql(spark, con, name):
    from check import compare
    assert compare(spark, con, name, FOLDER).startswith("ok")
