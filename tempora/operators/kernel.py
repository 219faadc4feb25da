"""The atom kernel: beliefs over claims with revisions, conflicts and dependencies.

atoms: atom_id, subject, predicate, object, valid_from, valid_to, tx_from, tx_to,
belief, confidence, claim_type, ai_usage, taint, permission, sources, evidence.
deps: from_id, to_id, kind. conflicts: conflict_id, atom_ids, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import temporal as tm
from tempora.operators.belief import belief_at
from tempora.operators.graph import reachable

RISKY = ("Untrusted", "PromptInjectionSuspected", "Quarantined")


def visible(atoms: DataFrame, valid: int | None, known: int | None) -> DataFrame:
    """Valid and known where asked; belief isn't looked at."""
    asked = ([] if valid is None else [tm.valid_at(valid)]) + ([] if known is None else [tm.known_at(known)])
    return atoms.filter(tm.all_of(asked))


def supported_for_ai() -> Column:
    c = F.col
    return c("belief").isin("Accepted", "Disputed") & (F.size("sources") > 0) & (F.size("evidence") > 0) & (c("ai_usage") != "Forbidden") & ~c("claim_type").isin("Simulation", "Hypothesis") & ~F.coalesce(c("taint"), F.lit("")).isin(*RISKY)


def beliefs_by_state(atoms: DataFrame, policy: str = "AcceptedOnly") -> DataFrame:
    """(belief, n, ids): visible atoms by belief under a policy."""
    states = {"AcceptedOnly": ["Accepted"], "IncludeDisputed": ["Accepted", "Disputed"], "IncludeSuperseded": ["Accepted", "Disputed", "Superseded"]}[policy]
    return atoms.filter(F.col("belief").isin(states)).groupBy("belief").agg(F.count("*").alias("n"))


def entity_state(atoms: DataFrame, revisions: DataFrame, entity: str, valid: int, known: int) -> DataFrame:
    """An entity's visible atoms with the belief of that time."""
    own = visible(atoms, valid, known).filter(F.col("subject") == entity)
    then = belief_at(own.select("atom_id", "belief"), revisions, known).withColumnRenamed("belief", "belief_then")
    return own.join(then, "atom_id")


def add_conflicts(atoms: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, edges): members of open conflicts that were Accepted are Disputed; each is tied to its conflict.

    Pairs inside a conflict go through the conflict's own node, so a conflict of
    n atoms makes 2n edges, and reaches the same atoms.
    """
    members = conflicts.filter("status != 'Resolved'").select("conflict_id", F.explode("atom_ids").alias("atom_id")).distinct()
    hit = members.select("atom_id").distinct().withColumn("__hit", F.lit(True))
    out = atoms.join(hit, "atom_id", "left").withColumn("belief", F.when(F.col("__hit") & (F.col("belief") == "Accepted"), "Disputed").otherwise(F.col("belief"))).drop("__hit")
    edges = members.select(F.col("atom_id").alias("a"), F.concat(F.lit("conflict:"), "conflict_id").alias("b"))
    return out, edges.union(edges.select("b", "a"))


def impact_if_retracted(deps: DataFrame, root: DataFrame) -> DataFrame:
    """(root, node, depth, kind): everything that depends on a root (id), by the prefix of its name."""
    closure = reachable(deps.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")), root)
    return closure.withColumn("kind", F.split("node", "-")[0])


def retract(atoms: DataFrame, deps: DataFrame, root: DataFrame) -> DataFrame:
    """Atoms with ``invalidated``: whether they depend on a root, which is itself retracted."""
    gone = impact_if_retracted(deps, root).select(F.col("node").alias("atom_id")).union(root.select("id")).distinct().withColumn("invalidated", F.lit(True))
    return atoms.join(gone, "atom_id", "left").withColumn("invalidated", F.coalesce("invalidated", F.lit(False)))


def verify_claim(atoms: DataFrame, revisions: DataFrame, subject=None, predicate=None, obj=None, valid=None, known=None, labels: list[str] | None = None, ai_facing: bool = False) -> DataFrame:
    """Atoms that bear on a claim pattern: time, permission, belief and evidence filters in this order."""
    pattern = [F.col(c) == v for c, v in (("subject", subject), ("predicate", predicate), ("object", obj)) if v is not None]
    found = visible(atoms.filter(tm.all_of(pattern)), valid, known)
    if labels is not None:
        found = found.filter(F.col("permission").isin(labels))
    if known is not None:
        found = found.drop("belief").join(belief_at(found.select("atom_id", "belief"), revisions, known), "atom_id")
    return found.filter(supported_for_ai()) if ai_facing else found.filter(~F.col("belief").isin("Rejected", "Retracted"))


def summary_leaks(deps: DataFrame, atoms: DataFrame, labels: list[str]) -> DataFrame:
    """(from_id, to_id): summaries that depend on an atom outside the permitted labels."""
    return deps.filter("kind = 'SummaryOf'").join(atoms.filter(~F.col("permission").isin(labels)).select(F.col("atom_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
