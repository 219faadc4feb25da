"""Spreading activation over the heterogeneous graph of entities, assertions, sources and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm
from tempora.operators.memory import half_life_weight
from tempora.tables import saved

DAMPING, ROUNDS, HALF_LIFE, DEFAULT_TRUST = 0.85, 12, 365.0, 0.5
SUPERSEDED = 0.35


def words(text):
    """Distinct white-space tokens of more than two characters, lower-cased, with _ and - as spaces."""
    t = fx.normalize_name(F.translate(text, "_-", "  "))
    return F.array_distinct(F.filter(F.split(t, " "), lambda x: F.length(x) > 2))


def content_overlap(a, b):
    return F.size(F.array_intersect(words(a), words(b)))


def adjacency(assertions: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """(a, b) both ways: an assertion with its ends and sources, a memory (id, entities) with its entities."""
    pairs = assertions.select("id", F.explode(F.array_compact(F.concat(F.array("subject", "obj_entity"), "source_ids"))).alias("b"))
    if memories is not None:
        pairs = pairs.union(memories.select("id", F.explode("entities").alias("b")))
    one = pairs.select(F.col("id").alias("a"), "b").distinct()
    return one.union(one.select("b", "a")).distinct()


def personalization(seeds: DataFrame, query: str, agent: str | None, entities: DataFrame, memories: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """(id, weight), summing to 1: seeds 1, preferred entities 0.5, named ones 0.7, the agent's memories 0.15, overlap 0.2 a word."""
    q = F.lit(query)
    folded = lambda c: fx.normalize_name(F.translate(c, "_-", "  "))
    named = entities.filter(F.contains(folded(q), folded(F.col("id"))) | F.coalesce(F.contains(folded(q), folded(F.col("canonical_name"))), F.lit(False)))
    parts = seeds.select("id", F.lit(1.0).alias("w")).union(named.select("id", F.lit(0.7))).union(memories.select("id", 0.2 * content_overlap(q, F.col("content")))).union(memories.filter(F.col("agent_id").eqNullSafe(F.lit(agent))).select("id", F.lit(0.15)))
    if preferred is not None:
        parts = parts.union(preferred.select("id", F.lit(0.5)))
    w = parts.groupBy("id").agg(F.sum("w").alias("w")).filter("w > 0")
    return w.crossJoin(F.broadcast(w.agg(F.sum("w").alias("t")))).select("id", (F.col("w") / F.col("t")).alias("weight"))


def rank(pairs: DataFrame, weights: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(node, score) after a fixed number of rounds; nodes without edges pass nothing on.

    Starts from the weights, and from 1 / n where a node has none.
    """
    e = saved(pairs, "activation")
    n = e.select("a").distinct().count()
    nodes = e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).join(weights.withColumnRenamed("id", "node"), "node", "left")
    nodes = saved(nodes.select("node", "n", F.coalesce("weight", F.lit(0.0)).alias("base"), F.coalesce("weight", F.lit(1.0 / max(1, n))).alias("start")), "activation-nodes")
    ranks = nodes.select("node", F.col("start").alias("score"))
    for _ in range(rounds):
        given = nodes.join(ranks, "node").select(F.col("node").alias("a"), (F.col("score") / F.col("n")).alias("g")).join(e, "a").groupBy(F.col("b").alias("node")).agg(F.sum("g").alias("g"))
        ranks = saved(nodes.join(given, "node", "left").select("node", ((1 - damping) * F.col("base") + damping * F.coalesce("g", F.lit(0.0))).alias("score")), "activation-ranks")
    return ranks


def activated(ranks: DataFrame, memories: DataFrame, trust: DataFrame, now: int) -> DataFrame:
    """(id, score): memories by rank, confidence, trust of their sources and age; superseded ones count for 0.35.

    ``memories``: id, confidence, valid_from (a date), status; ``trust``: id, trust.
    """
    j = memories.join(ranks.withColumnRenamed("node", "id").withColumnRenamed("score", "rank"), "id").join(trust, "id", "left")
    score = F.col("rank") * F.col("confidence") * fx.clamp(F.coalesce("trust", F.lit(DEFAULT_TRUST)), 0.01, 1.0) * half_life_weight(tm.age_days(now, "valid_from"), HALF_LIFE)
    return j.select("id", (score * F.when(F.col("status") == "Superseded", SUPERSEDED).otherwise(1.0)).alias("score")).orderBy(F.desc("score"), "id")
