"""What a unit of context is worth: recency, confidence, trust, centrality, relevance; citation coverage.

units: unit_id, text, level, required, assertion_ids, source_ids,
contradiction_ids, entity_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar as fx

#: What an atom's subject, predicate or object in the task is worth, the agent's own memory, a dispute.
IN_TASK = {"subject": 4, "predicate": 3, "object": 4}
OWN_MEMORY, DISPUTED = 5, 2
REQUIRED, LEVEL, LINKS, UNKNOWN = 3.0, 0.05, 8, 0.5
SIGNALS = ("recency", "confidence", "source_trust", "centrality", "relevance")


def centrality() -> Column:
    """How much hangs on a unit: its sources, assertions, contradictions and entities, of eight."""
    links = F.size("source_ids") + F.size("assertion_ids") + F.size("contradiction_ids") + F.size("entity_ids")
    return F.least(links / F.lit(float(LINKS)), F.lit(1.0))


def relevance(task: Column, text: Column) -> Column:
    """Share of the task's distinct words that the text has; 0 without words."""
    return fx.lexical_score(task, text)


def score_units(units: DataFrame, assertions: DataFrame, sources: DataFrame, task: str, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """``units`` with each signal and ``score``: their sum, 3 more if required, and 0.05 for each level.

    A unit without assertions counts as the latest, with confidence 0.5; one
    without sources has no trust, an unrated source 0.5.
    """
    latest = assertions.agg(F.max("tx_from")).first()[0] or 0  # one number
    a = units.select("unit_id", F.explode("assertion_ids").alias("id")).join(assertions.select("id", "tx_from", "confidence"), "id").groupBy("unit_id").agg(F.max("tx_from").alias("__t"), F.avg("confidence").alias("__c"))
    s = units.select("unit_id", F.explode("source_ids").alias("id")).join(sources.select("id", "trust_score"), "id", "left").groupBy("unit_id").agg(F.avg(F.coalesce("trust_score", F.lit(UNKNOWN))).alias("__s"))
    t = units.join(a, "unit_id", "left").join(s, "unit_id", "left")
    values = {
        "recency": fx.clamp(F.coalesce("__t", F.lit(latest)) / F.lit(float(latest)), 0.0, 1.0) if latest > 0 else F.lit(0.0), "confidence": F.coalesce("__c", F.lit(UNKNOWN)), "source_trust": F.coalesce("__s", F.lit(0.0)),
        "centrality": centrality(), "relevance": relevance(F.lit(task), F.col("text")),
    }
    out = t.withColumns({n: values[n] for n in signals}).drop("__t", "__c", "__s")
    return out.withColumn("score", sum((F.col(n) for n in signals), F.lit(0.0)) + F.when(F.col("required"), REQUIRED).otherwise(0.0) + F.col("level") * LEVEL)


def model_relevance(task: str, agent: str) -> Column:
    """What an atom is worth to an agent's task: subject, predicate and object that the task names, own memories, disputes."""
    t = F.lit(task.lower())
    named = sum((F.when(F.contains(t, fx.ascii_lower(F.col(c))), w).otherwise(0) for c, w in IN_TASK.items()), F.lit(0))
    own = (F.col("claim_type") == "AgentMemory") & F.coalesce(F.col("agent") == agent, F.lit(False))
    return named + F.when(own, OWN_MEMORY).otherwise(0) + F.when(F.col("belief") == "Disputed", DISPUTED).otherwise(0)


def top_assertions(assertions: DataFrame, k: int = 4) -> DataFrame:
    """The k assertions that a task-specific unit is made of: surest, latest, least id."""
    return assertions.orderBy(F.desc("confidence"), F.desc("tx_from"), "id").limit(k)


def citation_coverage(assertions: DataFrame) -> DataFrame:
    """(coverage): the share of assertions that name a source; 1 without any."""
    return assertions.agg(F.coalesce(F.avg((F.coalesce(F.size("source_ids"), F.lit(0)) > 0).cast("double")), F.lit(1.0)).alias("coverage"))


def graph_temporal_score(question: Column, wanted: Column) -> Column:
    """A memory's score by words, shared entities, kind, confidence and state of life (content, entities, kind, confidence, status)."""
    #: What a memory's kind adds, and what its state lets through.
    kinds = {0.35: ("Correction",), 0.2: ("Semantic", "Relationship", "WorldState"), 0.15: ("Preference", "Goal", "Plan"), 0.1: ("Episodic", "Procedural", "Reflection")}
    lives = {1.0: ("Active",), 1.2: ("Reinforced",), 0.15: ("Superseded", "Contradicted"), 0.05: ("Candidate", "Archived")}

    def pick(c: str, table: dict) -> Column:
        out = F.lit(0.0)
        for value, names in table.items():
            out = F.when(F.col(c).isin(*names), value).otherwise(out)
        return out

    shared = F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, F.col("entities"))) / F.size(wanted))
    return (0.45 * fx.lexical_score(question, F.col("content")) + 0.35 * shared + pick("kind", kinds) + 0.2 * F.col("confidence")) * pick("status", lives)


def narrative(rows: DataFrame, keys: list[str], line: Column, order: list[str], name: str = "text") -> DataFrame:
    """(keys, text): the lines of each key in order, as one text; for reports of a bounded number of lines a key."""
    return rows.select(*keys, F.struct(*order, line.alias("line")).alias("x")).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias(name))
