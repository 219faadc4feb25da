"""Belief: which claim is preferred, how that changed, what was believed at a moment; trust of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import temporal as tm
from tempora.functions.scalar import clamp, source_trust_baseline

CONFIDENCE, TRUST, RECENCY = 0.25, 0.7, 0.05
#: Weights of the eleven factors of a source's trust.
TRUST_WEIGHTS = {
    "source_type": 0.08, "issuer_identity": 0.12, "signature": 0.12, "historical_accuracy": 0.16, "domain_authority": 0.14, "recency": 0.08,
    "independence": 0.10, "corroboration": 0.08, "conflict": 0.06, "tamper": 0.04, "human_rating": 0.02,
}


def average_trust(assertions: DataFrame, sources: DataFrame, default_pct: float) -> DataFrame:
    """``assertions`` with trust_pct: the mean trust of their sources, the default for unknown or unrated ones and for none at all."""
    one = assertions.select("id", F.explode_outer("source_ids").alias("source")).join(sources.select(F.col("id").alias("source"), "trust_pct"), "source", "left")
    mean = one.groupBy("id").agg(F.avg(F.coalesce(F.col("trust_pct").cast("double"), F.lit(float(default_pct)))).alias("trust_pct"))
    return assertions.join(mean, "id")


UNIT, RECENT = 100_000_000, 1_000_000  # parts of a score; transactions that count as fully recent


def score_units() -> Column:
    """The claim score in whole parts of ``UNIT``: equal on every engine, so ties are ties."""
    parts = lambda x: F.round(x).cast("long")
    recent = F.least(F.greatest(F.col("tx_from"), F.lit(0)), F.lit(RECENT)) * int(RECENCY * UNIT / RECENT)
    return parts(F.col("confidence") * (CONFIDENCE * UNIT)) + parts(F.col("trust_pct") * (TRUST * UNIT / 100)) + recent


def claim_score() -> Column:
    """Confidence, trust and how recent the transaction is, weighted; up to 1,000,000 counts as recent."""
    return score_units() / UNIT


def preferred_claim(claims: DataFrame, valid_at: int, known_at: int, keys=("subject", "predicate")) -> DataFrame:
    """The preferred claim of each key among those valid and known (a claim is known from its transaction on)."""
    at = claims.filter(tm.valid_at(valid_at) & (F.col("tx_from") <= known_at))
    w = Window.partitionBy(*keys).orderBy(F.desc(score_units()), F.desc("tx_from"), "id")
    return at.withColumn("competing", F.count("*").over(Window.partitionBy(*keys)) - 1).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def belief_revisions(claims: DataFrame, keys=("subject", "predicate")) -> DataFrame:
    """(keys, known_at, previous, next): where the preferred claim changes as claims arrive in order of transaction and id.

    The best so far is a running maximum, so one window sort does it.
    """
    # ids break ties downwards: an earlier row with the same score and transaction stays, as rows come in order of id
    w = Window.partitionBy(*keys).orderBy("tx_from", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct(score_units().alias("s"), F.col("tx_from").alias("t"), (-F.col("nth")).alias("n"), F.col("id").alias("id"))).over(upto)["id"]
    rows = claims.withColumn("nth", F.row_number().over(w)).withColumn("next", best)
    rows = rows.withColumn("previous", F.lag("next").over(w)).filter(~F.col("next").eqNullSafe(F.col("previous")))
    return rows.select(*keys, F.col("tx_from").alias("known_at"), "previous", "next")


def belief_at(atoms: DataFrame, revisions: DataFrame, t: int) -> DataFrame:
    """(atom_id, belief): the state before the earliest revision known after t, else the current one.

    ``atoms`` has atom_id and belief; ``revisions`` has atom_id, seq, known_at, previous, next.
    """
    later = revisions.filter(F.col("known_at") > t).groupBy("atom_id").agg(F.min_by("previous", F.struct("known_at", "seq")).alias("then"))
    return atoms.join(later, "atom_id", "left").select("atom_id", F.coalesce("then", "belief").alias("belief"))


def reputation(events: DataFrame, key: str = "source_id", kind: str = "kind") -> DataFrame:
    """Counters of each source's history and rates from them; 0.5 accuracy without a history."""
    n = lambda k: F.count_if(F.col(kind) == k)
    t = events.groupBy(key).agg(n("accurate").alias("accurate"), n("inaccurate").alias("inaccurate"), n("conflict").alias("conflicts"), F.count("*").alias("total"))
    judged = F.col("accurate") + F.col("inaccurate") + F.col("conflicts")
    return t.withColumn("accuracy", F.when(judged > 0, F.col("accurate") / judged).otherwise(F.lit(0.5))).withColumn("conflict_rate", F.col("conflicts") / F.col("total"))


def human_delta(events: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, delta): ratings (+1, -1) add 0.05 each in order of seq, held within 0.25 after every one.

    Clamping after each step isn't a sum; it is a fold over the ordered ratings.
    """
    ordered = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "rating"))).alias("r"))
    fold = F.aggregate("r", F.lit(0), lambda acc, x: F.greatest(F.lit(-5), F.least(F.lit(5), acc + x["rating"].cast("int"))))
    return ordered.select(key, (fold * 0.05).alias("delta"))


def independence(n: Column, shared: Column) -> Column:
    """From the number of distinct sources and of pairs with a common issuer."""
    return clamp(F.when(n <= 1, F.lit(0.35)).otherwise(F.least(0.45 + 0.18 * n, F.lit(1.0))) - 0.12 * shared, 0.0, 1.0)


def score_source(t: DataFrame, now: int) -> DataFrame:
    """``t`` with trust: the weighted mean of eleven factors.

    ``t``: source_type, verified, signed (booleans), accuracy, authority,
    observed_at, independence, conflict_rate, tamper, human_delta.
    """
    factors = {
        "source_type": source_trust_baseline(F.col("source_type")), "issuer_identity": F.when(F.col("verified"), 1.0).otherwise(0.25), "signature": F.when(F.col("signed"), 1.0).otherwise(0.0), "historical_accuracy": F.col("accuracy"), "domain_authority": F.col("authority"),
        "recency": clamp(1 / (1 + F.greatest(F.lit(now) - F.col("observed_at"), F.lit(0)) / 1000), 0.0, 1.0), "independence": F.col("independence"), "corroboration": 0.25 + 0.75 * F.col("independence"),
        "conflict": 1 - F.col("conflict_rate"), "tamper": 1 - F.col("tamper"), "human_rating": clamp(0.5 + F.col("human_delta"), 0.0, 1.0),
    }
    total = sum(clamp(v, 0.0, 1.0) * TRUST_WEIGHTS[k] for k, v in factors.items())
    return t.withColumn("trust", total / sum(TRUST_WEIGHTS.values()))


def trust_band(scores: Column) -> Column:
    """From the least known score: Trusted from 0.8, Mixed from 0.5, else Untrusted."""
    return F.when(scores >= 0.8, "Trusted").when(scores >= 0.5, "Mixed").when(scores.isNotNull(), "Untrusted").otherwise("Unknown")
