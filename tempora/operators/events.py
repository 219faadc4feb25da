"""The event log: validation, state as latest-per-key, hashes, segments, recovery.

A log row has seq, kind, tx, idempotency_key and a payload of its kind's columns.
State is an aggregate over the log, so replay and incremental maintenance agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.aggregates import latest_per_key


def sequence(commands: DataFrame, order: list[str], last_tx: int = 0) -> DataFrame:
    """Commands with tx and event_id, numbered in order after ``last_tx``.

    Numbers come from counts per range partition and positions inside, so the
    whole log never passes through one task.
    """
    ranged = commands.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    from tempora.tables import saved

    ranged = saved(ranged, "commands")
    first = ranged.groupBy("__p").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    first = first.withColumn("__before", before)
    tx = F.col("__i") - F.col("__first") + F.col("__before") + 1 + last_tx
    out = ranged.join(F.broadcast(first), "__p").withColumn("tx", tx)
    return out.withColumn("event_id", F.concat(F.lit("evt-"), F.lpad(F.col("tx").cast("string"), 18, "0"), F.lit("-"), F.col("kind"))).drop("__p", "__i", "__first", "__n", "__before")


def idempotent(new: DataFrame, log: DataFrame, key: str = "idempotency_key", fingerprint: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(to append, conflicts): keys already logged are dropped if their fingerprint is the same and conflict if not."""
    first = latest_per_key(new.withColumn("__o", -F.monotonically_increasing_id()), [key], ["__o"]).drop("__o")
    have = log.select(key, F.col(fingerprint).alias("__f")).distinct()
    joined = first.join(have, key, "left")
    return joined.filter("__f is null").drop("__f"), joined.filter(F.col("__f") != F.col(fingerprint)).drop("__f")


def replay_latest(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    return latest_per_key(log, [key], [order])


def apply_retractions(assertions: DataFrame, retractions: DataFrame) -> DataFrame:
    """Retracted assertions get the status and end of transaction time; valid time stays. ``retractions``: id, tx."""
    r = retractions.groupBy("id").agg(F.max("tx").alias("__tx"))
    j = assertions.join(r, "id", "left")
    return j.withColumn("status", F.when(F.col("__tx").isNotNull(), "Retracted").otherwise(F.col("status"))).withColumn("tx_to", F.coalesce("__tx", "tx_to")).drop("__tx")


def apply_confidence(assertions: DataFrame, updates: DataFrame) -> DataFrame:
    """The last confidence of each id holds; its sources are united with those known, sorted. ``updates``: id, seq, confidence, source_ids."""
    last = updates.groupBy("id").agg(F.max_by("confidence", "seq").alias("__c"), F.array_distinct(F.flatten(F.collect_list("source_ids"))).alias("__s"))
    j = assertions.join(last, "id", "left")
    return j.withColumn("confidence", F.coalesce("__c", "confidence")).withColumn("source_ids", F.when(F.col("__s").isNotNull(), F.array_sort(F.array_union("source_ids", "__s"))).otherwise(F.col("source_ids"))).drop("__c", "__s")


def violations(assertions: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, rule) for assertions that may not be added: repeated ids, unknown subjects, objects or sources, no source, wrong ranges."""
    ids, src = entities.select("id").distinct(), sources.select("id").distinct()
    rule = lambda df, name: df.select("id", F.lit(name).alias("rule")).distinct()
    return (
        rule(assertions.groupBy("id").count().filter("count > 1"), "duplicate-id")
        .union(rule(assertions.join(ids.select(F.col("id").alias("subject")), "subject", "left_anti"), "unknown-subject"))
        .union(rule(assertions.filter("obj_kind = 'Entity'").join(ids.select(F.col("id").alias("obj_entity")), "obj_entity", "left_anti"), "unknown-object"))
        .union(rule(assertions.select("id", F.explode("source_ids").alias("s")).join(src.select(F.col("id").alias("s")), "s", "left_anti"), "unknown-source"))
        .union(rule(assertions.filter("coalesce(size(source_ids), 0) < 1"), "no-source"))
        .union(rule(assertions.filter("confidence < 0 or confidence > 1"), "confidence"))
        .union(rule(assertions.filter("valid_to < valid_from or tx_to < tx_from"), "interval"))
    )


def state_hash(df: DataFrame) -> DataFrame:
    """One row: an order-free hash of all rows and their number."""
    cols = sorted(df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s"))


def segments(log: DataFrame, size: int) -> DataFrame:
    """(segment, first, last, n, checksum) of a log cut every ``size`` sequence numbers."""
    return log.groupBy(F.floor(F.col("seq") / size).alias("segment")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(log.columns))).alias("checksum"))


def recover(records: DataFrame) -> DataFrame:
    """The longest valid beginning of a log: rows (seq, ok) before the first bad one."""
    bad = records.filter("not ok").agg(F.min("seq").alias("bad"))
    return records.crossJoin(F.broadcast(bad)).filter("bad is null or seq < bad").drop("bad")


def gaps(log: DataFrame) -> DataFrame:
    """Sequence numbers that don't follow their predecessor: a self-join on the number, not a global sort."""
    s = log.select("seq").distinct()
    first = s.agg(F.min("seq").alias("f"))
    return s.join(s.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti").crossJoin(F.broadcast(first)).filter("seq != f").select("seq")


def snapshot_and_tail(snapshot: DataFrame, log: DataFrame, boundary: int, key: str = "key", order: str = "seq") -> DataFrame:
    """State from a snapshot and the log after its boundary."""
    return latest_per_key(snapshot.unionByName(log.filter(F.col(order) > boundary)), [key], [order])


def parity(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
