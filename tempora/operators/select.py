"""Bitemporal selection: filters, ordered limits and point lookups over assertions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import temporal as tm

DEFAULT_LIMIT, MAX_LIMIT, MAX_DEPTH = 100, 1000, 8


def query_limit(n: int | None) -> int:
    """The limit to use: 100 unless given, an error above 1000 or below 1."""
    n = DEFAULT_LIMIT if n is None else n
    if not 1 <= n <= MAX_LIMIT:
        raise ValueError(f"a limit lies between 1 and {MAX_LIMIT}")
    return n


def path_depth(n: int) -> int:
    if not 0 <= n <= MAX_DEPTH:
        raise ValueError(f"a path has at most {MAX_DEPTH} hops")
    return n


@dataclass(frozen=True)
class GraphQuery:
    """Conditions that must all hold; None asks nothing. Status is not looked at.

    ``context`` is compared as it is, with None for the global one, if ``any_context`` is off.
    """

    subject: str | None = None
    predicate: str | None = None
    obj_entity: str | None = None
    obj_text: str | None = None
    valid_at: int | None = None
    known_at: int | None = None
    min_confidence: float | None = None
    context: str | None = None
    any_context: bool = True
    limit: int | None = None

    def condition(self) -> Column:
        c = F.col
        asked = [c(n) == getattr(self, n) for n in ("subject", "predicate", "obj_entity", "obj_text") if getattr(self, n) is not None]
        if self.valid_at is not None:
            asked.append(tm.valid_at(self.valid_at))
        if self.known_at is not None:
            asked.append(tm.known_at(self.known_at))
        if self.min_confidence is not None:
            asked.append(c("confidence") >= self.min_confidence)
        if not self.any_context:
            asked.append(c("context").eqNullSafe(self.context))
        return tm.all_of(asked)


def find(assertions: DataFrame, q: GraphQuery) -> DataFrame:
    """Matching assertions by id, at most the query's limit."""
    return assertions.filter(q.condition()).orderBy("id").limit(query_limit(q.limit))


def visible_at(assertions: DataFrame, valid: int, known: int) -> DataFrame:
    return assertions.filter(tm.visible_at(valid, known))


def valid_at(assertions: DataFrame, t: int) -> DataFrame:
    """Active and valid."""
    return assertions.filter((F.col("status") == "Active") & tm.valid_at(t))


def known_at(assertions: DataFrame, t: int, active_only: bool = False) -> DataFrame:
    """Known, of any status unless only active ones are asked for."""
    out = assertions.filter(tm.known_at(t))
    return out.filter(F.col("status") == "Active") if active_only else out


def changed_between(assertions: DataFrame, a: int, b: int) -> DataFrame:
    """Transaction time begins or ends in [a, b]."""
    return assertions.filter(F.col("tx_from").between(a, b) | F.col("tx_to").between(a, b))


def active_during(assertions: DataFrame, start: int, end: int | None) -> DataFrame:
    return assertions.filter((F.col("status") == "Active") & tm.overlaps("valid_from", "valid_to", F.lit(start), F.lit(end).cast("long")))


def superseded_after(assertions: DataFrame, t: int) -> DataFrame:
    return assertions.filter((F.col("status") != "Active") & ((F.col("tx_to") > t) | (F.col("tx_from") > t)))


def adjacent_at(assertions: DataFrame, entity: str, t: int) -> DataFrame:
    """Active assertions that touch an entity on either side at t."""
    return valid_at(assertions, t).filter((F.col("subject") == entity) | (F.col("obj_entity") == entity))


def by_source(assertions: DataFrame, source: str, evidence_links: DataFrame | None = None) -> DataFrame:
    """Assertions that name a source, or that an evidence link (assertion_id, source_id) ties to it."""
    named = F.array_contains("source_ids", source)
    if evidence_links is None:
        return assertions.filter(named)
    linked = evidence_links.filter(F.col("source_id") == source).select(F.col("assertion_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    return assertions.join(linked, "id", "left").filter(named | F.col("linked")).drop("linked")


def timeline(assertions: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """An entity's assertions from either end, with names, by start and id."""
    names = entities.select("id", "canonical_name")
    touched = assertions.filter((F.col("subject") == entity) | (F.col("obj_entity") == entity))
    s, o = names.select(F.col("id").alias("subject"), F.col("canonical_name").alias("subject_name")), names.select(F.col("id").alias("obj_entity"), F.col("canonical_name").alias("object_name"))
    return touched.join(s, "subject", "left").join(o, "obj_entity", "left").orderBy("valid_from", "id")


def confidence_bucket(pct="pct") -> Column:
    """Tenths of confidence, ten at most, from whole percents."""
    return F.least(F.floor(tm.col(pct) / 10), F.lit(10)).cast("int")


def memory_visible(memories: DataFrame, agent: str, t: int, include_superseded: bool = False) -> DataFrame:
    out = memories.filter((F.col("agent_id") == agent) & tm.valid_at(t))
    return out if include_superseded else out.filter(F.col("status") != "Superseded")


def verify(assertions: DataFrame, subject: str, predicate: str, obj_text: str, t: int) -> DataFrame:
    """One row with the verdict on a claim: Contradicted, Supported or InsufficientEvidence, in this order of precedence."""
    at = valid_at(assertions, t).filter((F.col("subject") == subject) & (F.col("predicate") == predicate))
    same = F.count_if(F.col("obj_text") == obj_text)
    other = F.count_if(F.col("obj_text") != obj_text)
    return at.agg(same.alias("supporting"), other.alias("opposing")).withColumn("verdict", F.when(F.col("opposing") > 0, "Contradicted").when(F.col("supporting") > 0, "Supported").otherwise("InsufficientEvidence"))
