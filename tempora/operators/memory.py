"""Vector search and memory retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm

#: How much a memory's state of life lets through.
LIFECYCLE = {"Active": 1.0, "Reinforced": 1.2, "Superseded": 0.15, "Contradicted": 0.05}


def knn(vectors: DataFrame, query: DataFrame, k: int, id: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, score, rank): the k rows closest by cosine to the one query vector, ties to the smaller id.

    The one query row travels as a broadcast; the limit is a top-k in each task
    and one merge, so nothing is sorted in whole.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    q = F.broadcast(query.select(F.col(vector).alias("__q")).limit(1))
    score = F.round(fx.cosine(F.col(vector), F.col("__q")), 6)
    top = vectors.crossJoin(q).select(id, score.alias("score")).filter("score is not null").orderBy(F.desc("score"), id).limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id)))


def valid_vector():
    v = F.col("embedding")
    return F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def lifecycle_factor(status="status"):
    out = F.lit(0.0)
    for k, w in LIFECYCLE.items():
        out = F.when(F.col(status) == k, w).otherwise(out)
    return out


def retrieve(memories: DataFrame, question: str, k: int, agent: str | None = None, valid_at: int | None = None) -> DataFrame:
    """(id, score): memories that share words with the question, best first, ties by id."""
    t = memories
    if agent is not None:
        t = t.filter(F.col("agent_id") == agent)
    if valid_at is not None:
        t = t.filter(tm.valid_at(valid_at))
    score = fx.lexical_score(F.lit(question), F.col("content")) * lifecycle_factor()
    return t.select("id", F.round(score, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def half_life_weight(age_days, half_life: float = 365.0, floor: float = 0.05):
    return F.greatest(F.pow(F.lit(0.5), age_days / half_life), F.lit(floor))


def consolidate(memories: DataFrame, least: int = 2) -> DataFrame:
    """(agent_id, text, n, first): memories of one agent that say the same, often enough."""
    text = fx.normalize_name(F.col("content"))
    return memories.groupBy("agent_id", F.md5(text).alias("text")).agg(F.count("*").alias("n"), F.min("id").alias("first")).filter(F.col("n") >= least)


def recent_entities(assertions: DataFrame, capacity: int) -> DataFrame:
    """(id, last): the most recently mentioned entities, at most ``capacity``."""
    seen = assertions.select(F.col("subject").alias("id"), F.col("tx_from").alias("t")).union(assertions.filter("obj_kind = 'Entity'").select("obj_entity", "tx_from"))
    return seen.groupBy("id").agg(F.max("t").alias("last")).orderBy(F.desc("last"), "id").limit(capacity)
