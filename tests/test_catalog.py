"""Every catalogue query runs on the smallest tables; where there is SQL, DuckDB gives the same rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lyrebird.plans import catalog

DATA = "/root/testdata/sf0.001"
catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if value is None or value is pd.NA or value != value:
        return "null"
    if hasattr(value, "item"):
        value = value.item()
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame, columns):
    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(frame.columns)
    if name in catalog.SQL:
        expected = duck.execute(catalog.SQL[name]).df()
        columns = sorted(expected.columns)
        assert sorted(frame.columns) == columns
        assert rows(frame, columns) == rows(expected, columns)
