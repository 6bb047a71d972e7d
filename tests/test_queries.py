"""Every registered core query against its reference SQL on the smallest tables."""

import datetime as dt
import decimal
import math
import os

import pytest

from threadloom.plans import registry

DATA = os.environ.get("THREADLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    if name not in registry.ORACLES:
        assert got
        return
    found = duck.sql(registry.ORACLES[name])
    order = [found.columns.index(c) for c in columns]
    want = sorted([tuple(plain(r[i]) for i in order) for r in found.fetchall()], key=repr)
    assert sorted(found.columns) == columns
    assert got == want
