"""Interval algebra as Column expressions.

Intervals are half-open, a null end is open, and an empty interval (end equal to
start) contains nothing though it may overlap a surrounding one. Times are plain
integers; encodings are never mixed in one expression. Every predicate is a
conjunction of comparisons without coalesce, so that it reaches the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def contains(start, end, t) -> Column:
    return (col(start) <= col(t)) & (col(end).isNull() | (col(end) > col(t)))


def overlaps(s1, e1, s2, e2) -> Column:
    return (col(e2).isNull() | (col(s1) < col(e2))) & (col(e1).isNull() | (col(s2) < col(e1)))


def before(s1, e1, s2, e2) -> Column:
    return F.coalesce(col(e1) < col(s2), F.lit(False))


def meets(s1, e1, s2, e2) -> Column:
    return F.coalesce(col(e1) == col(s2), F.lit(False))


def ends_before(e1, e2) -> Column:
    """Whether end e1 comes strictly before end e2; an open end is last."""
    return col(e1).isNotNull() & (col(e2).isNull() | (col(e1) < col(e2)))


def during(s1, e1, s2, e2) -> Column:
    return (col(s2) < col(s1)) & ends_before(e1, e2)


def allen(s1, e1, s2, e2) -> Column:
    """The first that holds of equals, before, after, meets, starts, finishes, during, contains, overlaps; else none."""
    s1, e1, s2, e2 = map(col, (s1, e1, s2, e2))
    strict = (s1 < s2) & (e1.isNull() | (s2 < e1)) & ends_before(e1, e2)
    rules = (
        ("equals", (s1 == s2) & e1.eqNullSafe(e2)), ("before", before(s1, e1, s2, e2)), ("after", before(s2, e2, s1, e1)), ("meets", meets(s1, e1, s2, e2)), ("starts", (s1 == s2) & ends_before(e1, e2)),
        ("finishes", (s2 < s1) & e1.eqNullSafe(e2)), ("during", during(s1, e1, s2, e2)), ("contains", during(s2, e2, s1, e1)), ("overlaps", strict),
    )
    out = F.lit("none")
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def all_of(conditions) -> Column:
    """The conjunction; true without conditions."""
    return reduce(and_, conditions, F.lit(True))


def valid_at(t) -> Column:
    return contains("valid_from", "valid_to", t)


def known_at(t) -> Column:
    return contains("tx_from", "tx_to", t)


def visible_at(valid, known) -> Column:
    """Active, valid and known."""
    return (F.col("status") == "Active") & valid_at(valid) & known_at(known)


def age_days(now: int, then) -> Column:
    """Whole days between two YYYYMMDD integers in 365-day years and 30-day months; values under 1,000,000 are bare years."""

    def days(x):
        x = col(x)
        year = F.when(x < 1_000_000, x).otherwise(F.floor(x / 10_000))
        month = F.when(x < 1_000_000, 1).otherwise(F.floor(x / 100) % 100)
        day = F.when(x < 1_000_000, 1).otherwise(x % 100)
        return year * 365 + (month - 1) * 30 + (day - 1)

    return F.greatest(days(F.lit(now)) - days(then), F.lit(0))
