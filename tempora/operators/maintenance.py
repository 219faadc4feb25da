"""Background jobs: each looks at what changed after a cursor and suggests actions for review.

All jobs return (job, target, detail), so a run is the union of its jobs and the
next cursor is the largest transaction time seen. The cursor is a filter on
transaction time, which reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions.scalar import normalize_name
from tempora.operators import aggregates as ax
from tempora.operators import contradictions as cx
from tempora.operators.graph import reachable

RISKY = ("Untrusted", "PromptInjectionSuspected", "Quarantined")


def _suggest(df: DataFrame, job: str, target, detail=None) -> DataFrame:
    return df.select(F.lit(job).alias("job"), F.col(target).cast("string").alias("target"), (F.lit(None) if detail is None else F.col(detail)).cast("string").alias("detail"))


def assertion_jobs(assertions: DataFrame, entities: DataFrame, sources: DataFrame, cursor: int, now: int, lag: int, low_trust_pct: int = 50, known: list[str] | None = None) -> DataFrame:
    """Stale facts, contradictions, communities and summaries touched, low trust, broken edges, unknown predicates."""
    new = ax.changed_since(assertions, cursor)
    # a contradiction's sides share a subject: only subjects that changed are joined
    near = assertions.join(new.select("subject").distinct(), "subject", "left_semi")
    found = cx.touching(cx.contradictions(near), new.select("id"))
    drift = new.filter(~F.col("predicate").isin(known or [])).groupBy("predicate").agg(F.count("*").alias("n")) if known else new.limit(0).select("predicate", F.lit(0).alias("n"))
    return (
        _suggest(ax.stale_assertions(assertions, cursor, now, lag), "stale", "id")
        .union(_suggest(found, "contradiction", "contradiction_id", "type"))
        .union(_suggest(ax.touched_entities(assertions, cursor), "recompute-community", "id"))
        .union(_suggest(new, "refresh-summary", "id"))
        .union(_suggest(ax.recalibrate_trust(sources, cursor, low_trust_pct), "recalibrate-trust", "id", "trust_pct"))
        .union(_suggest(cx.broken_relationships(new, entities), "broken-relationship", "id", "obj_entity"))
        .union(_suggest(drift, "ontology-drift", "predicate", "n"))
    )


def next_cursor(assertions: DataFrame, cursor: int) -> int:
    r = assertions.agg(F.greatest(F.max("tx_from"), F.max("tx_to")).alias("t")).first()["t"]  # one number
    return max(cursor, r or cursor)


# jobs over atoms: atom_id, subject, predicate, object, belief, confidence, tx_from, tenant, agent, claim_type, sources, taint


def duplicate_names(atoms: DataFrame, cursor: int) -> DataFrame:
    """Subjects that share a tenant and a normalized name with a smaller one; only names with a new atom."""
    names = atoms.filter("predicate = 'ENTITY_NAME'").select("tenant", normalize_name(F.col("object")).alias("k"), "subject", "tx_from")
    g = names.groupBy("tenant", "k").agg(F.min("subject").alias("least"), F.max("tx_from").alias("t")).filter(F.col("t") > cursor)
    j = names.join(g, ["tenant", "k"]).filter("subject != least").select("subject", "least").distinct()
    return _suggest(j, "entity-deduplication", "subject", "least")


def source_trust(atoms: DataFrame, conflicts: DataFrame, cursor: int, low: float = 0.5) -> DataFrame:
    """Sources of new atoms that are in an open conflict, unsure or tainted, with how many."""
    bad = conflicts.filter("status != 'Resolved'").select(F.explode("atom_ids").alias("atom_id")).distinct().withColumn("hit", F.lit(True))
    j = atoms.filter(F.col("tx_from") > cursor).join(bad, "atom_id", "left").filter(F.col("hit") | (F.col("confidence") < low) | F.coalesce(F.col("taint").isin(*RISKY), F.lit(False)))
    return _suggest(j.select(F.explode("sources").alias("source"), "atom_id").groupBy("source").agg(F.count_distinct("atom_id").alias("n")), "source-trust", "source", "n")


def stale_beliefs(atoms: DataFrame, now: int, lag: int) -> DataFrame:
    return _suggest(atoms.filter(F.col("belief").isin("Candidate", "Disputed") & (now - F.col("tx_from") >= lag)), "stale-belief", "atom_id", "belief")


def repeated_memories(atoms: DataFrame) -> DataFrame:
    """Memories of one agent that say the same at least twice: the least id, and how often."""
    m = atoms.filter("claim_type = 'AgentMemory'").groupBy("agent", normalize_name(F.col("object")).alias("k")).agg(F.min("atom_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return _suggest(m, "memory-consolidation", "first", "n")


def stale_summaries(atoms: DataFrame, deps: DataFrame, conflicts: DataFrame, cursor: int) -> DataFrame:
    """Summaries that changed, or that depend on an atom that is in conflict, changed or isn't accepted."""
    bad = conflicts.filter("status != 'Resolved'").select(F.explode("atom_ids").alias("atom_id")).union(atoms.filter((F.col("tx_from") > cursor) | (F.col("belief") != "Accepted")).select("atom_id")).distinct()
    direct = deps.join(bad.withColumnRenamed("atom_id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("atom_id"))
    s = atoms.filter("claim_type = 'Summary'").select("atom_id")
    own = atoms.filter((F.col("claim_type") == "Summary") & (F.col("tx_from") > cursor)).select("atom_id")
    return _suggest(s.join(direct.union(own).distinct(), "atom_id", "left_semi"), "summary-invalidation", "atom_id")


def invalid_dependents(atoms: DataFrame, deps: DataFrame, cursor: int) -> DataFrame:
    """What depends, however far, on new atoms that aren't accepted."""
    root = atoms.filter((F.col("tx_from") > cursor) & (F.col("belief") != "Accepted")).select(F.col("atom_id").alias("id"))
    return _suggest(reachable(deps.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")), root).select("root", "node"), "dependency-invalidation", "node", "root")


def weak_causes(causal: DataFrame, low: float = 0.5) -> DataFrame:
    """Causal atoms (cause, effect, mechanism, notes, confidence) that are unsure or lack a mechanism or notes."""
    c = causal.filter((F.col("confidence") < low) | F.col("mechanism").isNull() | F.col("notes").isNull())
    return _suggest(c, "causal-refinement", "cause", "effect")


def invalidated_communities(roots: DataFrame, changed: DataFrame) -> DataFrame:
    """(root) of components (node, root) that changed assertions touch."""
    ends = changed.select(F.col("subject").alias("node")).union(changed.filter("obj_kind = 'Entity'").select("obj_entity")).distinct()
    return roots.join(ends, "node", "left_semi").select("root").distinct()


def affected_cache_keys(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """(key) of cached answers whose dependencies (key, id) include a changed id."""
    return dependencies.join(changed.select("id").distinct(), "id", "left_semi").select("key").distinct()
