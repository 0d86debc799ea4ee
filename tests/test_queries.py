"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from marisma import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == columns
    assert sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall()) == got


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name,table", [("normalise_fold", "documents"), ("worker_composition", "documents"), ("explain_contrib", "lineitem")])
def test_no_row_is_left_out(spark, name, table):
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    out = registry.queries()[name](spark, FOLDER)
    assert out.count() == rows.count()
    if name == "normalise_fold":
        assert out.join(rows.select("doc_id", "text"), "doc_id").where("length(folded) <> length(lower(text))").count() == 0
