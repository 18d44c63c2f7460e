"""Each registered query with SQL gives DuckDB's rows."""

import datetime

import duckdb
import pytest

from docketry.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())
