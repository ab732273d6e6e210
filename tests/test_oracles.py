"""Every query with SQL gives the rows of that SQL; every other runs with a stable schema."""

import math
import os
from collections import Counter

import duckdb
import pytest

from attestry.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    mine = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    theirs = Counter(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
