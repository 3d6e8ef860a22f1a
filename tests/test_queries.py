from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(values):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
