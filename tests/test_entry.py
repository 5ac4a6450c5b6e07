"""Each query with SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/sf0.01/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{data}/sf0.01/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(key(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, data, name):
    df = entry.queries()[name](spark, f"{data}/sf0.01")
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_sequences(spark, duck, data):
    n, orders = (duck.sql(f"select count(*) from {t}").fetchall()[0][0] for t in ("events", "orders"))
    got = {name: entry.queries()[name](spark, f"{data}/sf0.01").toPandas() for name in ("counts_sorted", "union", "quantile_ranges", "index_counts")}
    assert got["counts_sorted"].cnt.sum() == got["index_counts"].query("rid == 0").cnt.sum() == n
    assert got["quantile_ranges"].rid.max() == (orders - 1) // 100
