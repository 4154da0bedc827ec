"""Every registered reference query against its DuckDB text on the smallest tables."""

import math

import duckdb
import pytest

from sparklore import catalog
from sparklore.plans.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.8g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalog.ORACLE:
        relation = duck.sql(catalog.ORACLE[name])
        assert sorted(relation.columns) == columns
        where = [relation.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in where) for r in relation.fetchall()), key=str)
