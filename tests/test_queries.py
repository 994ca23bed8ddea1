"""Every registered query against its equivalent SQL on the same tables."""

import math
import os

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def table_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert got
        return
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert table_of(df.columns, got) == table_of(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 30
    assert set(ORACLE) <= set(QUERIES)


def test_letters_are_not_decided_by_rounding(spark):
    """No adjusted p lies so near 0.05 that two engines could differ."""
    for name in ("dunn_bh", "pairwise_ranksum"):
        assert QUERIES[name](spark, SF).filter("abs(p_adj - 0.05) < 1e-6").count() == 0
