"""Every registered query that has SQL, against it, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from registry import ORACLES, QUERIES, load_all
from tools_check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    found = [tuple(row) for row in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    result = con.execute(ORACLES[name])
    columns = [item[0] for item in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, found) == rows_of(columns, result.fetchall())
