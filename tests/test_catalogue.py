import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalogue

DATA = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=str)
    if name in catalogue.ORACLES:
        expected = tables.sql(catalogue.ORACLES[name])
        assert sorted(expected.columns) == columns
        assert rows == sorted(expected.project(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str)


def test_entry_lists_all():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "type", "score"]
