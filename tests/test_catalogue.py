"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from meshloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = tables.execute(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert tidy(got) == tidy(want)


def test_entry_imports():
    import __spark_entry__

    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql()) and set(catalogue.QUERIES) <= set(__spark_entry__.queries())
