"""Every query with SQL equals DuckDB on the small tables."""

import math

import duckdb
import pytest

from tidecal.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return round(float(v), 5) + 0.0


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = con.sql(registry.oracle_sql()[name])
    columns = sorted(expected.columns)
    rows = [dict(zip(expected.columns, r)) for r in expected.fetchall()]
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    key = lambda r: repr([x if not isinstance(x, float) else round(x, 3) for x in r])
    want = sorted(([plain(r[c]) for c in columns] for r in rows), key=key)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert all(near(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
