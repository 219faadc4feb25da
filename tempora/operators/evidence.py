"""Evidence packs, governance, sharing and packing into a budget."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.scalar import estimate_tokens
from tempora.operators.contradictions import touching


@dataclass
class Pack:
    """The closure of a question's assertions: flat frames, one for each kind of record."""

    assertions: DataFrame
    entities: DataFrame
    sources: DataFrame
    contradictions: DataFrame


def evidence_pack(selected: DataFrame, assertions: DataFrame, entities: DataFrame, sources: DataFrame, conflicts: DataFrame) -> Pack:
    """All that supports or opposes the ``selected`` assertions.

    Contradictions are those of the whole store that touch a selected assertion,
    whatever the question's times; their other sides join the pack. Entities and
    sources are those the pack's assertions name; unknown ones are left out.
    """
    ids = selected.select("id")
    near = touching(conflicts, ids)
    every = ids.union(near.select(F.col("assertion_a").alias("id"))).union(near.select(F.col("assertion_b").alias("id"))).distinct()
    chosen = assertions.join(every, "id", "left_semi")
    ends = chosen.select(F.col("subject").alias("id")).union(chosen.filter("obj_kind = 'Entity'").select(F.col("obj_entity").alias("id"))).distinct()
    named = chosen.select(F.explode("source_ids").alias("id")).distinct()
    return Pack(chosen, entities.join(ends, "id", "left_semi"), sources.join(named, "id", "left_semi"), near)


def governed(assertions: DataFrame, tenant: str, denied_sources: DataFrame) -> DataFrame:
    """What a tenant may read: assertions of its context, none of whose sources is denied (id). Global ones are not its own."""
    own = assertions.filter(F.col("context") == f"tenant:{tenant}")
    bad = own.select("id", F.explode("source_ids").alias("source")).join(denied_sources.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct()
    return own.join(bad, "id", "left_anti")


def audit(assertions: DataFrame, tenant: str, denied_sources: DataFrame) -> DataFrame:
    """(id, decision): allowed, or which rule denies it."""
    denied = assertions.select("id", F.explode("source_ids").alias("source")).join(denied_sources.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct().withColumn("bad", F.lit(True))
    other = ~F.col("context").eqNullSafe(F.lit(f"tenant:{tenant}"))
    return assertions.join(denied, "id", "left").select("id", F.when(other, "denied-tenant").when(F.col("bad"), "denied-source").otherwise("allowed").alias("decision"))


def redacted(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """Sources under redaction ``rules`` (id, mode): delete drops the row, uri and hash mask a field."""
    r = rules.groupBy("id").agg(F.bool_or(F.col("mode") == "delete").alias("gone"), F.bool_or(F.col("mode") == "uri").alias("no_uri"), F.bool_or(F.col("mode") == "hash").alias("no_hash"))
    j = sources.join(r, "id", "left").filter("not coalesce(gone, false)")
    return j.withColumn("uri", F.when(F.col("no_uri"), "[REDACTED]").otherwise(F.col("uri"))).withColumn("content_hash", F.when(F.col("no_hash"), "[REDACTED]").otherwise(F.col("content_hash"))).drop("gone", "no_uri", "no_hash")


def greedy_budget(units: DataFrame, budget: int, keys: list[str], order: list[Column], tokens: str = "tokens", id: str = "id") -> DataFrame:
    """(keys, id, tokens): units taken in rank order while they fit; one that doesn't fit is skipped and the next tried.

    A skipping fold isn't a running sum. It runs over each key's units as they
    come sorted, batch by batch, and carries only the key and the tokens left, so
    a key may hold any number of units.
    """
    rows = units.filter(F.col(tokens) <= budget).repartition(*keys).sortWithinPartitions(*keys, *order)
    rows = rows.select(*keys, F.col(id), F.col(tokens).cast("long").alias(tokens))
    width = len(keys)

    def run(batches):
        key, left = None, budget
        for batch in batches:
            taken = []
            for i, (*own, n) in enumerate(zip(*[batch.column(j).to_pylist() for j in (*range(width), width + 1)], strict=True)):
                if own != key:
                    key, left = own, budget
                if n <= left:
                    taken.append(i)
                    left -= n
            yield batch.take(pa.array(taken, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def pack_texts(texts: DataFrame, budget: int, keys: list[str], order: list[Column], text: str = "content", id: str = "id") -> DataFrame:
    return greedy_budget(texts.withColumn("tokens", estimate_tokens(F.col(text))), budget, keys, order, id=id)


def allows_exchange(owner: Column, reader: Column, visibility: Column, shared_with: Column, same_team: Column) -> Column:
    """Whether a reader may have a record: its owner always; private ones only if named; team ones inside the team; others all."""
    return F.when(owner == reader, True).when(visibility == "Private", F.array_contains(shared_with, reader)).when(visibility == "Team", same_team).otherwise(visibility.isin("Organization", "Public"))


def federated(graphs: dict[str, tuple[DataFrame, float, bool]]) -> DataFrame:
    """The permitted graphs' assertions with the graph's name and confidence weighted by its trust, as one frame."""
    out = None
    for name, (df, trust, permitted) in sorted(graphs.items()):
        if permitted:
            part = df.select("id", "subject", "predicate", F.coalesce("obj_entity", "obj_text").alias("object"), F.lit(name).alias("graph"), F.round(F.col("confidence") * trust, 6).alias("weighted"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise PermissionError("no graph may be read")
    return out


def knowledge_delta(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by ``keys`` that only one side has, with the side's name."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    on = lambda x, y: F.expr(" and ".join(f"x.{k} <=> y.{k}" for k in keys))  # noqa: E731, ARG005
    only = lambda x, y, side: x.alias("x").join(y.alias("y"), on(x, y), "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").union(only(b, a, "right"))


def k_anonymous_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n) for values that at least k rows share; others are suppressed."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= k)


def compress(units: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Units (keys, id, text, required, score, level) of a context that fit the budget, in the order they are taken.

    Required ones come first, then by score, level and id. What doesn't fit is
    skipped; a required one is cut to the tokens that remain.
    """
    t = units.withColumn("tokens", estimate_tokens(F.col("text")))
    w = Window.partitionBy(*keys).orderBy(F.desc("required"), F.desc("score"), F.desc("level"), "id")
    rows = t.withColumn("r", F.row_number().over(w)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("r", F.col("tokens").cast("long").alias("n"), "id", "required"))).alias("u"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<struct<r:int,n:bigint,id:{units.schema['id'].dataType.simpleString()}>>").alias("taken"))

    def step(acc, x):
        n = F.when(x["n"] <= acc["left"], x["n"]).when(x["required"], acc["left"]).otherwise(F.lit(0).cast("long"))
        return F.when(n > 0, F.struct((acc["left"] - n).alias("left"), F.concat(acc["taken"], F.array(F.struct(x["r"].alias("r"), n.alias("n"), x["id"].alias("id")))).alias("taken"))).otherwise(acc)

    taken = rows.select(*keys, F.explode(F.aggregate("u", start, step)["taken"]).alias("x")).select(*keys, F.col("x.id").alias("id"), F.col("x.r").alias("position"), F.col("x.n").alias("kept"))
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    j = taken.join(t, [*keys, "id"])
    return j.select(*keys, "id", "position", "kept", F.when(F.col("kept") < F.col("tokens"), F.array_join(F.slice(words, F.lit(1), F.col("kept").cast("int")), " ")).otherwise(F.col("text")).alias("text"))
