"""Every query with SQL equals it on the smallest tables."""

import math
import os

import duckdb
import pytest

from factloom.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, engine, name):
    out = all_queries()[name](spark, DATA)
    columns = sorted(out.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in out.collect())
    if name not in all_sql():
        assert rows
        return
    cursor = engine.execute(all_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
