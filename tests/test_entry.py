"""Every registered query against its SQL on the smallest tables."""

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_point
from gazette.plans import catalog
from tools.check import TABLES, _rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
OWN = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    return connection


def test_every_query_has_sql():
    assert set(OWN) == set(OWN) & set(QUERIES) & set(ORACLES)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, cursor.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
