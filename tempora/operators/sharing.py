"""Several agents over one graph: who may read what, what to share, and private counts.

records: claim_id, created_by, visibility, shared_with, text, confidence, tx_from;
members: team, agent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.operators.evidence import k_anonymous_counts


def readable(records: DataFrame, members: DataFrame, agent: str) -> DataFrame:
    """Records that an agent may read: its own, public ones, those shared with it, and team ones of a team it shares with the owner."""
    mates = members.join(members.filter(F.col("agent") == agent).select("team"), "team", "left_semi").select(F.col("agent").alias("created_by")).distinct().withColumn("mate", F.lit(True))
    j = records.join(mates, "created_by", "left")
    v = F.col("visibility")
    ok = (F.col("created_by") == agent) | v.isin("Organization", "Public") | ((v == "Private") & F.coalesce(F.array_contains("shared_with", agent), F.lit(False))) | ((v == "Team") & F.coalesce("mate", F.lit(False)))
    return j.filter(ok).drop("mate")


def recommend_sharing(records: DataFrame, members: DataFrame, target: str, sources: list[str], objective: str, k: int = 10) -> DataFrame:
    """(claim_id, share_from, score): what other agents know, the target doesn't read yet and may get, by the share of the objective's words."""
    own = records.filter(F.col("created_by") == target).select("claim_id")
    known = own.union(records.filter((F.col("visibility") == "Private") & F.array_contains("shared_with", target)).select("claim_id")).distinct()
    open_ = readable(records, members, target).filter(F.col("created_by").isin(sources)).join(known, "claim_id", "left_anti")
    score = F.round(fx.lexical_score(F.lit(objective), F.col("text")), 6)
    return open_.select("claim_id", F.col("created_by").alias("share_from"), score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "claim_id").limit(k)


def exchange(records: DataFrame, members: DataFrame, target: str) -> DataFrame:
    """(claim_id, decision): the audit of giving each record to the target, denials included."""
    ok = readable(records, members, target).select("claim_id").distinct().withColumn("ok", F.lit(True))
    return records.join(ok, "claim_id", "left").select("claim_id", F.when(F.col("ok"), "shared").otherwise("denied").alias("decision"))


def accepted(records: DataFrame) -> DataFrame:
    """Public records; of several with the same text the surest, then latest, then least id."""
    w = Window.partitionBy(fx.normalize_name(F.col("text"))).orderBy(F.desc("confidence"), F.desc("tx_from"), "claim_id")
    return records.filter(F.col("visibility") == "Public").withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def noise(seed: int, label: str, epsilon: float) -> float:
    """A repeatable value of at most 1 / epsilon either way, never 0, from a seed and a label."""
    h = seed % 2**64
    for b in label.encode():
        h = (h ^ b) * 0x1000000001B3 % 2**64
        h ^= h >> 32
    centred = fx.splitmix64(h) % 2001 / 1000 - 1
    return (centred or 0.5) / epsilon


def private_counts(df: DataFrame, key: str, k: int, epsilon: float, seed: int) -> DataFrame:
    """(key, n): counts of at least k with repeatable noise, not under 0; smaller groups are suppressed."""

    def run(batches):
        for pdf in batches:
            pdf["n"] = [max(0.0, n + noise(seed, str(v), epsilon)) for v, n in zip(pdf[key], pdf["n"], strict=True)]
            yield pdf

    counts = k_anonymous_counts(df, key, k).select(key, F.col("n").cast("double").alias("n"))
    return counts.mapInPandas(run, counts.schema)
