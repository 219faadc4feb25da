"""The retrieval harness: strategies against cases with gold evidence, scored and ranked.

Frames are those of an evaluation file: cases (id, question, valid_at, known_at,
tags, gold ids), evidence, paths, contradictions. Cases are a stated query set;
they are broadcast against the evidence, and only rows with a score go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm
from tempora.operators.aggregates import set_metrics
from tempora.tables import saved

#: How many records each strategy takes, its latency in microseconds and its cost.
STRATEGIES = {"vector": (3, 700, 2.0), "keyword": (3, 300, 1.0), "graph": (4, 550, 1.5), "temporal_graph": (4, 650, 1.8), "hybrid": (5, 950, 3.5)}
ROUTING_US, ROUTING_COST = 80, 0.2
#: Which words of a question speak for a predicate.
PREDICATE_WORDS = {
    "WORKED_AT": ("work", "worked", "employ", "job"), "OWNS": ("own", "ownership", "control", "controls"), "CEO_OF": ("ceo", "chief executive"), "SUPPLIES": ("supply", "supplier", "supplying"),
    "HAS_CONTRACT_WITH": ("contract", "customer", "affected"), "CAUSES": ("cause", "event", "linked", "increase"),
}
#: The words behind each dimension of the keyword embedding; the last dimension is always 1.
EMBEDDING_WORDS = (
    ("work", "employ", "job"), ("own", "control", "ownership"), ("supply", "supplier", "contract", "customer"), ("sanction", "oil", "causes", "causal", "event"),
    ("memory", "agent", "prefer", "conversation"), ("contradict", "conflict", "ceo"), ("time", "2024", "2026", "historical"),
)
HYBRID_TAGS = ("contradiction", "agent_memory", "counterfactual", "supply_chain", "causal_chain")


def folded(text: Column) -> Column:
    return F.translate(fx.ascii_lower(F.trim(text)), "_-", "  ")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out |= text.contains(w)
    return out


def embedding(text: Column) -> Column:
    t = folded(text)
    return F.array(*[_any(t, words).cast("double") for words in EMBEDDING_WORDS], F.lit(1.0))


def search_text() -> Column:
    return F.concat_ws(" ", "subject", "predicate", "object", F.translate(fx.ascii_lower(F.col("predicate")), "_", " "), "text")


def graph_score() -> Column:
    q, has = folded(F.col("question")), lambda t: F.array_contains("tags", t)
    score = sum((F.when(F.contains(q, folded(F.col(c))), 1.0).otherwise(0.0) for c in ("subject", "object", "predicate")), F.lit(0.0))
    score += F.when(F.contains(q, folded(F.col("predicate"))), 1.0).otherwise(0.0)  # once as it is, once in words
    for p, words in PREDICATE_WORDS.items():
        score += F.when((F.col("predicate") == p) & _any(q, words), 1.0).otherwise(0.0)
    score += F.when(has("multi_hop") & F.col("predicate").isin("OWNS", "CAUSES", "SUPPLIES", "HAS_CONTRACT_WITH"), 0.75).otherwise(0.0)
    return score + F.when(has("contradiction") & (F.col("predicate") == "CEO_OF"), 1.0).otherwise(0.0)


def visible() -> Column:
    v, k = F.col("valid_at"), F.col("known_at")
    return (v.isNull() | tm.contains("valid_from", "valid_to", v)) & (k.isNull() | (F.col("known_from") <= k))


def route() -> Column:
    """The strategy that a case's tags call for."""
    has = lambda t: F.array_contains("tags", t)
    hybrid = F.lit(False)
    for t in HYBRID_TAGS:
        hybrid |= has(t)
    return F.when(hybrid, "hybrid").when(has("temporal_qa"), "temporal_graph").when(has("multi_hop"), "graph").otherwise("hybrid")


def retrieve(cases: DataFrame, evidence: DataFrame, paths: DataFrame, strategies: list[str]) -> DataFrame:
    """(strategy, routed, case_id, evidence_id): what each strategy takes; ``adaptive`` routes by tags.

    Graph strategies go on to whole paths: one record of a path brings the
    others, until nothing is added.
    """
    c = cases.withColumnRenamed("id", "case_id").withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies]))).withColumn("routed", F.when(F.col("strategy") == "adaptive", route()).otherwise(F.col("strategy")))
    j = evidence.withColumnRenamed("id", "evidence_id").crossJoin(F.broadcast(c.select("case_id", "strategy", "routed", "question", "tags", "valid_at", "known_at")))
    text = search_text()
    keyword = fx.keyword_score(F.col("question"), text).cast("double")
    vector = fx.cosine(embedding(F.col("question")), embedding(text))
    kind = F.col("routed")
    score = F.when(kind == "vector", vector).when(kind == "keyword", keyword).when(kind.isin("graph", "temporal_graph"), graph_score()).otherwise(keyword + vector + 1.5 * graph_score() + F.when(visible(), 0.25).otherwise(0.0))
    allowed = ~kind.isin("temporal_graph", "hybrid") | visible()
    k = F.lit(0)
    for name, (n, _, _) in STRATEGIES.items():
        k = F.when(kind == name, n).otherwise(k)
    w = Window.partitionBy("strategy", "case_id").orderBy(F.desc("score"), "evidence_id")
    got = j.filter(allowed).withColumn("score", F.round(score, 9)).filter("score > 0").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("strategy", "routed", "case_id", "evidence_id")
    by_path = paths.select(F.col("id").alias("path_id"), F.explode("evidence_ids").alias("evidence_id"))
    got, n = saved(got, "retrieved"), -1
    while True:
        grown = got.filter(F.col("routed").isin("graph", "temporal_graph", "hybrid")).join(by_path, "evidence_id").select("strategy", "routed", "case_id", "path_id").distinct().join(by_path, "path_id").select("strategy", "routed", "case_id", "evidence_id")
        got = saved(got.union(grown).distinct(), "retrieved")
        was, n = n, got.count()
        if n == was:
            return got


def scored(cases: DataFrame, evidence: DataFrame, paths: DataFrame, contradictions: DataFrame, got: DataFrame) -> DataFrame:
    """One row a strategy and case: recall, precision, temporal correctness, path recall, contradiction F1, freshness, accuracy."""
    sets = got.groupBy("strategy", "routed", "case_id").agg(F.collect_set("evidence_id").alias("got"))
    every = cases.withColumnRenamed("id", "case_id").crossJoin(got.select("strategy").distinct())
    t = every.join(sets, ["strategy", "case_id"], "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    whole = got.join(paths.select(F.col("id").alias("path_id"), F.explode("evidence_ids").alias("evidence_id"), F.size(F.array_distinct("evidence_ids")).alias("need")), "evidence_id")
    p = whole.groupBy("strategy", "case_id", "path_id", "need").agg(F.count_distinct("evidence_id").alias("n")).filter("n = need").groupBy("strategy", "case_id").agg(F.collect_set("path_id").alias("got_paths"))
    sides = contradictions.select(F.col("id").alias("cid"), F.explode(F.array("assertion_a", "assertion_b")).alias("evidence_id")).distinct()
    x = got.join(sides, "evidence_id").groupBy("strategy", "case_id", "cid").agg(F.count_distinct("evidence_id").alias("n")).filter("n = 2").groupBy("strategy", "case_id").agg(F.collect_set("cid").alias("got_contradictions"))
    seen = got.join(evidence.select(F.col("id").alias("evidence_id"), "valid_from", "valid_to", "known_from"), "evidence_id").join(cases.select(F.col("id").alias("case_id"), "valid_at", "known_at"), "case_id")
    stale = seen.groupBy("strategy", "case_id").agg(F.avg((~visible()).cast("double")).alias("stale"))
    newest = cases.select(F.col("id").alias("case_id"), F.explode("gold_evidence_ids").alias("evidence_id")).join(evidence.select(F.col("id").alias("evidence_id"), "known_from"), "evidence_id").groupBy("case_id").agg(F.max_by("evidence_id", F.struct("known_from", "evidence_id")).alias("newest"))
    none = F.array().cast("array<string>")
    t = t.join(p, ["strategy", "case_id"], "left").join(x, ["strategy", "case_id"], "left").join(stale, ["strategy", "case_id"], "left").join(newest, "case_id", "left")
    recall, precision, _ = set_metrics(F.col("got"), F.col("gold_evidence_ids"))
    path_recall, _, _ = set_metrics(F.coalesce("got_paths", none), F.col("required_path_ids"))
    _, _, contradiction = set_metrics(F.coalesce("got_contradictions", none), F.col("gold_contradiction_ids"))
    timed = F.col("valid_at").isNotNull() | F.col("known_at").isNotNull()
    error = F.when(~timed, 0.0).when(F.size("got") == 0, 1.0).otherwise(F.coalesce("stale", F.lit(0.0)))
    fresh = F.when(~F.array_contains("tags", "agent_memory"), 1.0).when(F.array_contains("got", F.col("newest")), 1.0).otherwise(0.0)
    return t.select("strategy", "case_id", recall.alias("recall"), precision.alias("precision"), F.when(recall >= 1, 1.0).otherwise(0.0).alias("accuracy"), (1 - error).alias("temporal"), error.alias("staleness"), path_recall.alias("path_recall"), contradiction.alias("contradiction_f1"), fresh.alias("freshness"))


def report(scores: DataFrame) -> DataFrame:
    """(strategy, means of all metrics, cases), best accuracy first."""
    metrics = [c for c in scores.columns if c not in ("strategy", "case_id")]
    return scores.groupBy("strategy").agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in metrics]).orderBy(F.desc("accuracy"), F.desc("recall"), "strategy")
