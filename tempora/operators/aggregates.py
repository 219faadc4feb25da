"""Batch aggregations: health, maintenance with cursors, ontology mining, evaluation, learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalar import clamp
from tempora.operators.contradictions import max_concurrent_objects
from tempora.operators.select import confidence_bucket


def confidence_buckets(assertions: DataFrame) -> DataFrame:
    return assertions.groupBy(confidence_bucket().alias("bucket")).agg(F.count("*").alias("n"))


def graph_health(entities: DataFrame, assertions: DataFrame, sources: DataFrame, duplicates: DataFrame, contradictions: DataFrame, broken: DataFrame, low_trust_pct: int = 50, stale_before: int | None = None) -> DataFrame:
    """One row of counts of the graph's defects, and a score that loses 0.05 for each of them."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    stale = assertions.filter("status = 'Active'").filter(F.col("tx_from") < stale_before) if stale_before is not None else assertions.limit(0)
    parts = [one(entities, "entities"), one(assertions, "assertions"), one(sources, "sources"), one(duplicates, "duplicates"), one(stale, "stale"), one(contradictions, "contradictions"), one(broken, "broken"), one(sources.filter(F.col("trust_pct") < low_trust_pct), "low_trust")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    penalty = sum(F.col(c) for c in ("duplicates", "stale", "contradictions", "broken", "low_trust"))
    return out.withColumn("health", clamp(1 - 0.05 * penalty.cast("double"), 0.0, 1.0))


def changed_since(assertions: DataFrame, cursor: int) -> DataFrame:
    """What a maintenance job with this cursor looks at: begun or ended in transaction time after it."""
    return assertions.filter((F.col("tx_from") > cursor) | (F.col("tx_to") > cursor))


def stale_assertions(assertions: DataFrame, cursor: int, now: int, lag: int) -> DataFrame:
    return changed_since(assertions, cursor).filter((F.col("status") == "Active") & (now - F.col("tx_from") >= lag))


def recalibrate_trust(sources: DataFrame, cursor: int, below_pct: int) -> DataFrame:
    return sources.filter((F.col("observed_at") > cursor) & (F.col("trust_pct") < below_pct))


def touched_entities(assertions: DataFrame, cursor: int) -> DataFrame:
    new = changed_since(assertions, cursor)
    return new.select(F.col("subject").alias("id")).union(new.filter("obj_kind = 'Entity'").select("obj_entity")).distinct()


def predicate_mining(assertions: DataFrame, entities: DataFrame, known: list[str]) -> DataFrame:
    """Unknown predicates: support, the subject and object type if there is but one, and whether any interval ends."""
    t = assertions.filter(~F.col("predicate").isin(known)) if known else assertions
    types = entities.select("id", "entity_type")
    t = t.join(types.select(F.col("id").alias("subject"), F.col("entity_type").alias("st")), "subject", "left").join(types.select(F.col("id").alias("obj_entity"), F.col("entity_type").alias("ot")), "obj_entity", "left")
    only = lambda c: F.when(F.min(c) == F.max(c), F.max(c))  # one type exactly if the least is the greatest
    return t.groupBy("predicate").agg(F.count("*").alias("support"), only("st").alias("subject_type"), only("ot").alias("object_type"), F.bool_or(F.col("valid_to").isNotNull()).alias("temporal"))


def temporal_patterns(assertions: DataFrame) -> DataFrame:
    """Per predicate: how many, how many bounded, share of open ones, mean length of bounded ones."""
    return assertions.groupBy("predicate").agg(F.count("*").alias("n"), F.count("valid_to").alias("bounded"), F.round(1 - F.count("valid_to") / F.count("*"), 6).alias("open_ratio"), F.round(F.avg(F.col("valid_to") - F.col("valid_from")), 6).alias("mean_length"))


def type_clusters(entities: DataFrame, known: list[str], least: int = 2) -> DataFrame:
    return entities.filter(~F.col("entity_type").isin(known)).groupBy("entity_type").agg(F.count("*").alias("members")).filter(F.col("members") >= least)


def cardinality_candidates(assertions: DataFrame, least: int = 2) -> DataFrame:
    """Predicates whose subjects repeat but never hold two objects at once: one object at a time, confidence 0.85."""
    edges = assertions.filter("obj_kind = 'Entity'")
    repeated = edges.groupBy("predicate", "subject").agg(F.count("*").alias("n")).filter("n > 1").select("predicate").distinct()
    most = max_concurrent_objects(edges).groupBy("predicate").agg(F.max("most").alias("most"))
    support = edges.groupBy("predicate").agg(F.count("*").alias("support")).filter(F.col("support") >= least)
    return support.join(most.filter("most = 1"), "predicate").join(repeated, "predicate").select("predicate", "support", F.lit(0.85).alias("confidence"))


def missing_facts(required: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(known.select(*keys).distinct(), keys, "left_anti")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a map-side combined maximum rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def contradiction_rate(assertions: DataFrame) -> DataFrame:
    """(subject, objects): facts with more than one object."""
    return assertions.groupBy("subject", "predicate").agg(F.count_distinct(F.coalesce("obj_entity", "obj_text")).alias("objects")).filter("objects > 1")


# evaluation


def set_metrics(got: Column, want: Column) -> tuple[Column, Column, Column]:
    """Recall, precision and F1 of two id arrays; recall of nothing wanted is 1, precision of nothing got is 0 unless nothing is wanted."""
    hit = F.size(F.array_intersect(got, want))
    recall = F.when(F.size(want) == 0, 1.0).otherwise(hit / F.size(F.array_distinct(want)))
    precision = F.when(F.size(got) == 0, F.when(F.size(want) == 0, 1.0).otherwise(0.0)).otherwise(hit / F.size(F.array_distinct(got)))
    return recall, precision, F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)


def percentiles(df: DataFrame, value: str, keys: list[str], at=(50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles: the value at index ceil(n * p / 100) - 1, not interpolated."""
    return df.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by {value})").alias(f"p{p}") for p in at])


def leaderboard(df: DataFrame, name: str, score: str) -> DataFrame:
    """Mean score of each name and its rank, ties by name."""
    t = df.groupBy(name).agg(F.round(F.avg(score), 6).alias("score"), F.count("*").alias("cases"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), name)))


def best_arm(df: DataFrame, arm: str, reward: str) -> DataFrame:
    """The arm with the highest mean reward; ties to the smaller name."""
    t = df.groupBy(arm).agg(F.round(F.avg(reward), 6).alias("mean_reward"), F.count("*").alias("pulls"))
    return t.orderBy(F.desc("mean_reward"), arm).limit(1)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, pos, mean): the mean vector of each label, long."""
    return df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest_centroid(df: DataFrame, id: str, vector: str, means: DataFrame, label: str) -> DataFrame:
    """(id, predicted): the label whose mean is least far in squares, ties to the smaller label.

    Vectors meet centroids by position, so neither side is multiplied out before the sum.
    """
    x = df.select(id, F.posexplode(vector).alias("pos", "x"))
    d = x.join(means, "pos").groupBy(id, label).agg(F.round(F.sum((F.col("x").cast("double") - F.col("mean")) ** 2), 6).alias("d"))
    return d.groupBy(id).agg(F.min(F.struct("d", label)).alias("m")).select(id, F.col(f"m.{label}").alias("predicted"))


def bandit_update(events: DataFrame, arm: str, reward: str) -> DataFrame:
    return events.groupBy(arm).agg(F.count("*").alias("pulls"), F.sum(reward).alias("reward"))


def action_risk(base: str, external: Column, irreversible: Column, contradicted: Column, low_trust: Column) -> tuple[Column, Column]:
    """Risk of an action in [0, 1], two places, and its level; ``base``: read, write or other."""
    start = {"read": 0.2, "write": 0.45}.get(base, 0.65)
    plus = lambda c, w: F.when(c, w).otherwise(0.0)
    risk = F.round(F.least(start + plus(external, 0.15) + plus(irreversible, 0.25) + plus(contradicted, 0.15) + plus(low_trust, 0.1), F.lit(1.0)), 2)
    return risk, F.when(risk >= 0.85, "Critical").when(risk >= 0.65, "High").when(risk >= 0.35, "Medium").otherwise("Low")


def common_properties(properties: DataFrame) -> DataFrame:
    """(cluster, name, type): properties (cluster, id, name, type) that every entity of a cluster has, with one type."""
    size = properties.groupBy("cluster").agg(F.count_distinct("id").alias("all"))
    of = properties.groupBy("cluster", "name", "type").agg(F.count_distinct("id").alias("n"))
    return of.join(size, "cluster").filter("n = all").select("cluster", "name", "type")


def family_wins(results: DataFrame) -> DataFrame:
    """(baseline, wins): in how many families (family, baseline, score) a baseline is best, ties to the last name."""
    return results.groupBy("family").agg(F.max_by("baseline", F.struct("score", "baseline")).alias("baseline")).groupBy("baseline").agg(F.count("*").alias("wins"))


#: Weights of the parts of a quality score.
QUALITY = {
    "answer_accuracy": 0.18, "evidence_recall": 0.14, "evidence_precision": 0.1, "temporal_correctness": 0.12, "contradiction_f1": 0.1, "multi_hop_path_recall": 0.1, "citation_faithfulness": 0.1, "belief_revision_accuracy": 0.05,
    "causal_trace_recall": 0.04, "simulation_usefulness": 0.03, "tool_use_context_recall": 0.02, "compression_fidelity": 0.02,
}


def quality_score() -> Column:
    """The weighted sum of a row's twelve metrics, held in [0, 1]."""
    return clamp(sum((F.col(c) * w for c, w in QUALITY.items()), F.lit(0.0)), 0.0, 1.0)


def linear_score(features: Column, weights: dict[str, float], bias: float = 0.0) -> Column:
    """A linear policy's score of a map of features, held in [0, 1]; a feature that is missing counts 0."""
    return clamp(sum((F.coalesce(F.element_at(features, F.lit(k)), F.lit(0.0)) * w for k, w in weights.items()), F.lit(float(bias))), 0.0, 1.0)


def policy_report(examples: DataFrame, score: Column) -> DataFrame:
    """One row over examples (label, kind): mean reward (1 less the error), mean error, and how many were clicked or corrected."""
    error = F.abs(F.col("label") - score)
    return examples.agg(F.avg(1 - error).alias("mean_reward"), F.avg(error).alias("mean_error"), F.count_if(F.col("kind") == "click").alias("clicks"), F.count_if(F.col("kind") == "correction").alias("corrections"), F.count("*").alias("examples"))


def accuracy_by_task(predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """(task, accuracy, baseline, gain) of predictions (task, label, predicted) against a baseline's accuracy (task, baseline)."""
    own = predictions.groupBy("task").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return own.join(baseline, "task", "left").withColumn("gain", F.col("accuracy") - F.col("baseline"))
