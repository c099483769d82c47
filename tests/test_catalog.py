"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, rows_of

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_check_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_equals_sql(spark, con, name):
    frame = entry_module.queries()[name](spark, SF_DIR)
    found = rows_of(frame.columns, frame.collect())
    assert found
    if name in entry_module.oracle_sql():
        result = con.execute(entry_module.oracle_sql()[name])
        columns = [column[0] for column in result.description]
        assert sorted(frame.columns) == sorted(columns)
        assert found == rows_of(columns, result.fetchall())


def test_flagship(spark):
    assert entry_module.entry(spark).filter("`group` = 'closed_overall'").count() == 1
