"""Every query against its SQL twin on the small tables, and the driver contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sparkassay.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=repr)
    if name not in SQL:
        assert mine
        return
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
