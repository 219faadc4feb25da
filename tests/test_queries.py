"""Every registered query runs on the smallest tables and agrees with its SQL."""

from __future__ import annotations

import math
import os

import pytest

from tempora import agent_queries, queries  # noqa: F401  the first registers its own with the second's

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name in queries.ORACLES:
        r = duck.sql(queries.ORACLES[name])
        assert sorted(r.columns) == sorted(df.columns)
        want = r.project(", ".join(f'"{c}"' for c in sorted(r.columns))).fetchall()
        assert got == sorted(repr(tuple(map(plain, x))) for x in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
