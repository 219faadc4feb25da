"""Interval algebra against a plain Python model."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tempora.functions import temporal as tm

OPEN = 10**9


def model_allen(s1, e1, s2, e2):
    a, b = OPEN if e1 is None else e1, OPEN if e2 is None else e2
    if s1 == s2 and e1 == e2:
        return "equals"
    if e1 is not None and e1 < s2:
        return "before"
    if e2 is not None and e2 < s1:
        return "after"
    if e1 is not None and e1 == s2:
        return "meets"
    if s1 == s2 and a < b:
        return "starts"
    if s2 < s1 and a == b:
        return "finishes"
    if s2 < s1 and a < b:
        return "during"
    if s1 < s2 and b < a:
        return "contains"
    if s1 < s2 < a < b:
        return "overlaps"
    return "none"


interval = st.tuples(st.integers(0, 12), st.one_of(st.none(), st.integers(0, 6))).map(lambda x: (x[0], None if x[1] is None else x[0] + x[1]))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(interval, interval, st.integers(0, 14)), min_size=150, max_size=200))
def test_predicates_agree_with_the_model(spark, rows):
    df = spark.createDataFrame([(a[0], a[1], b[0], b[1], t) for a, b, t in rows], "s1 long, e1 long, s2 long, e2 long, t long")
    got = df.select("*", tm.contains("s1", "e1", F.col("t")).alias("has"), tm.overlaps("s1", "e1", "s2", "e2").alias("over"), tm.allen("s1", "e1", "s2", "e2").alias("rel")).collect()
    for r in got:
        e1, e2 = OPEN if r.e1 is None else r.e1, OPEN if r.e2 is None else r.e2
        assert r.has == (r.s1 <= r.t < e1)
        assert r.over == (r.s1 < e2 and r.s2 < e1)
        assert r.rel == model_allen(r.s1, r.e1, r.s2, r.e2)


def test_empty_interval_contains_nothing_but_overlaps_what_surrounds_it(spark):
    df = spark.createDataFrame([(5, 5, 1, 10)], "s1 long, e1 long, s2 long, e2 long")
    r = df.select(tm.contains("s1", "e1", F.lit(5)).alias("c"), tm.overlaps("s1", "e1", "s2", "e2").alias("o")).first()
    assert (r.c, r.o) == (False, True)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("valid_from"), F.col("id").alias("valid_to")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").filter(tm.valid_at(5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(valid_from,5)" in plan


def test_age_in_days(spark):
    df = spark.createDataFrame([(20230101,), (20240115,), (2020,)], "then long")
    assert [r.d for r in df.select(tm.age_days(20240201, F.col("then")).alias("d")).collect()] == [395, 16, 1490]
