"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest
from docketlake.plans import classify, harvest, rank, stream, urls
from docketlake.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
FAMILIES = (urls, classify, rank, harvest, stream)
WITH_SQL = [(f, n) for f in FAMILIES for n in f.SQL]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


@pytest.mark.parametrize(("family", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_sql(spark, duck, family, name):
    df = family.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(family.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
