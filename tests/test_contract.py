"""Every registered query against its DuckDB SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(name, spark, con):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    want = rows_of(list(rel.columns), rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_entry(spark):
    assert contract.entry(spark).count() > 0
