"""Interval self-joins: contradictions between assertions, conflicts between claims, concurrency.

All joins have equality keys (subject and context), so Spark plans a hash or
merge join with the interval test as its condition, and adaptive execution
splits hot keys. ``binned`` adds bins of valid time to the key, for subjects so
hot that even a split partition meets too many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import temporal as tm

SLUGS = {"LowerConfidenceReplacement": "lower-confidence-replacement", "MutuallyExclusivePredicates": "mutually-exclusive-predicates", "IncompatibleScalarValues": "incompatible-scalar-values", "ExactPredicateConflict": "exact-predicate-conflict"}
SEVERITY = {"LowerConfidenceReplacement": "Low", "MutuallyExclusivePredicates": "Critical", "IncompatibleScalarValues": "Medium", "ExactPredicateConflict": "High"}


def _sides(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "lr")


def _mapped(c: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def overlapping_pairs(df: DataFrame, keys: list[str], columns: list[str], extra: Column | None = None, bin_width: int | None = None, last: int | None = None) -> DataFrame:
    """Pairs l < r by id with equal keys (null equals null) and overlapping valid time.

    With ``bin_width`` rows go into every bin of valid time they touch, open ends
    up to ``last``; a pair is kept only in the bin of its later start, so once.
    """
    columns = list(dict.fromkeys([*keys, "id", "valid_from", "valid_to", *columns]))
    if bin_width:
        top = F.when(F.col("valid_to").isNull(), F.lit(last)).otherwise(F.col("valid_to") - 1)
        df = df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("valid_from") / bin_width), F.floor(F.greatest(top, F.col("valid_from")) / bin_width))))
        columns.append("bin")
    left, right = _sides(df, columns)
    on = tm.all_of([F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in [*keys, *(["bin"] if bin_width else [])]])
    on &= (F.col("l_id") < F.col("r_id")) & tm.overlaps("l_valid_from", "l_valid_to", "r_valid_from", "r_valid_to")
    if bin_width:
        on &= F.col("l_bin") == F.floor(F.greatest("l_valid_from", "r_valid_from") / bin_width)
    if extra is not None:
        on &= extra
    return left.join(right, on)


def contradictions(assertions: DataFrame, exclusive: DataFrame | None = None, **bins) -> DataFrame:
    """(assertion_a, assertion_b, type, severity, contradiction_id, predicate_a, predicate_b, overlap_from), one row a pair.

    Same subject and context, overlapping valid time; transaction time doesn't
    count. In this order: one side active and surer about the same object of the
    same predicate replaces the other (it is side a); else both must be active,
    and their predicates be configured as exclusive (``exclusive``: predicate_a,
    predicate_b, a small configuration), or the same predicate have different
    objects, both scalar or not.
    """
    c = F.col
    same_predicate = c("l_predicate") == c("r_predicate")
    same_object = (c("l_obj_kind") == c("r_obj_kind")) & c("l_obj_entity").eqNullSafe(c("r_obj_entity")) & c("l_obj_text").eqNullSafe(c("r_obj_text"))
    l_active, r_active = c("l_status") == "Active", c("r_status") == "Active"
    l_wins, r_wins = l_active & ~r_active & (c("l_pct") > c("r_pct")), r_active & ~l_active & (c("r_pct") > c("l_pct"))
    replacement = same_predicate & same_object & (l_wins | r_wins)
    clash = F.lit(False)
    if exclusive is not None:
        pairs = {frozenset((r[0], r[1])) for r in exclusive.select("predicate_a", "predicate_b").collect()}  # configuration
        for p in pairs:
            a, b = (*p, *p)[:2]
            clash |= ((c("l_predicate") == a) & (c("r_predicate") == b)) | ((c("l_predicate") == b) & (c("r_predicate") == a))
    both = l_active & r_active
    scalar = (c("l_obj_kind") != "Entity") & (c("r_obj_kind") != "Entity") & (c("l_obj_kind") != "Null") & (c("r_obj_kind") != "Null")
    kind = F.when(replacement, "LowerConfidenceReplacement").when(both & clash, "MutuallyExclusivePredicates").when(both & same_predicate & ~same_object, F.when(scalar, "IncompatibleScalarValues").otherwise("ExactPredicateConflict"))
    pairs = overlapping_pairs(assertions, ["subject", "context"], ["predicate", "obj_kind", "obj_entity", "obj_text", "status", "pct"], kind.isNotNull(), **bins).withColumn("type", kind)
    swap = (c("type") == "LowerConfidenceReplacement") & r_wins
    a, b = F.when(swap, c("r_id")).otherwise(c("l_id")), F.when(swap, c("l_id")).otherwise(c("r_id"))
    return pairs.select(
        a.alias("assertion_a"), b.alias("assertion_b"), "type", _mapped(c("type"), SEVERITY).alias("severity"), F.concat_ws("-", F.lit("contradiction"), a, b, _mapped(c("type"), SLUGS)).alias("contradiction_id"),
        c("l_subject").alias("subject"), c("l_context").alias("context"), c("l_predicate").alias("predicate_a"), c("r_predicate").alias("predicate_b"), F.greatest("l_valid_from", "r_valid_from").alias("overlap_from"),
    )


def touching(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Contradictions with a side among ``ids`` (id)."""
    ids = ids.select("id").distinct()
    a = found.join(ids.withColumnRenamed("id", "assertion_a"), "assertion_a", "left_semi")
    b = found.join(ids.withColumnRenamed("id", "assertion_b"), "assertion_b", "left_semi")
    return a.unionByName(b).dropDuplicates(["contradiction_id"])


def claim_conflicts(claims: DataFrame, threshold_pct: int = 50) -> DataFrame:
    """(claim_a, claim_b, type): claims of one subject and predicate that overlap in valid time.

    Same object: a source-trust disagreement if average trusts (trust_pct) differ
    by the threshold. Else by the predicate's words, then by the objects' kinds.
    """
    c = F.col
    same = c("l_obj_kind").eqNullSafe(c("r_obj_kind")) & c("l_obj_entity").eqNullSafe(c("r_obj_entity")) & c("l_obj_text").eqNullSafe(c("r_obj_text"))
    p, gap = F.upper("l_predicate"), F.abs(c("l_trust_pct") - c("r_trust_pct")) >= threshold_pct
    both = lambda k: (c("l_obj_kind") == k) & (c("r_obj_kind") == k)
    other = F.when(p.contains("STATUS") | (p == "STATE"), "MutuallyExclusiveStatus").when(p.contains("CAUSE"), "CausalDisagreement").when(both("Time"), "DateMismatch")
    other = other.when(c("l_obj_kind").isin("Integer", "Decimal") & c("r_obj_kind").isin("Integer", "Decimal"), "NumericMismatch").when(p.contains("IDENTITY") | (p == "SAME_AS"), "EntityIdentityMismatch").otherwise("ValidTimeOverlapConflict")
    kind = F.when(same, F.when(gap, "SourceTrustDisagreement")).otherwise(other)
    pairs = overlapping_pairs(claims, ["subject", "predicate"], ["obj_kind", "obj_entity", "obj_text", "trust_pct"], kind.isNotNull())
    return pairs.select(c("l_id").alias("claim_a"), c("r_id").alias("claim_b"), kind.alias("type"))


def max_concurrent_objects(assertions: DataFrame) -> DataFrame:
    """(subject, predicate, most): the largest number of different objects that hold at once, by a sweep over starts and ends.

    An end frees its object before a start at the same time takes one; empty
    intervals hold nothing.
    """
    from pyspark.sql import Window

    obj = F.coalesce("obj_entity", "obj_text")
    live = assertions.filter("valid_to is null or valid_to > valid_from").select("subject", "predicate", obj.alias("obj"), "valid_from", "valid_to")
    edges = live.select("subject", "predicate", F.col("valid_from").alias("t"), F.lit(1).alias("d")).union(live.filter("valid_to is not null").select("subject", "predicate", "valid_to", F.lit(-1)))
    edges = edges.groupBy("subject", "predicate", "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("subject", "predicate").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.withColumn("n", F.sum("d").over(w)).groupBy("subject", "predicate").agg(F.max("n").alias("most"))


def allen_histogram(assertions: DataFrame, keys=("subject", "context")) -> DataFrame:
    """(relation, n): how pairs of a key's assertions lie to each other."""
    left, right = _sides(assertions, [*keys, "id", "valid_from", "valid_to"])
    on = tm.all_of([F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]) & (F.col("l_id") < F.col("r_id"))
    return left.join(right, on).groupBy(tm.allen("l_valid_from", "l_valid_to", "r_valid_from", "r_valid_to").alias("relation")).agg(F.count("*").alias("n"))


def duplicate_entities(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(entity_a, entity_b): every entity with the least id of its key, so a group of n gives n - 1 rows, not all pairs."""
    from pyspark.sql import Window

    least = F.min("id").over(Window.partitionBy(*keys))
    return entities.withColumn("entity_a", least).filter("id != entity_a").select("entity_a", F.col("id").alias("entity_b"))


def broken_relationships(assertions: DataFrame, entities: DataFrame) -> DataFrame:
    """Assertions whose object entity doesn't exist."""
    return assertions.filter("obj_kind = 'Entity'").join(entities.select(F.col("id").alias("obj_entity")), "obj_entity", "left_anti").select("id", "obj_entity")
