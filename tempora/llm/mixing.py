"""Mixing sources to target weights with a time-varying curriculum.

Targets fill up by weight until a source would repeat more often than allowed;
the excess goes to the others. Inside a source documents stand in hash order and
repeat in passes, so the words taken form one line of demand. Each source has a
weight schedule over training time, piecewise linear; its integral is the
cumulative demand, and inverting it gives every copy of a document its training
position. Copies are range-sorted by position.

Cumulative words inside a source come from two levels of prefix sums, over
hash buckets of a source and inside a bucket, so a source that holds a third of
all rows is no larger task than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.frames import free_name, numbered, row_key, saved

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # times a source's size that its target can reach
BUCKET_ROWS = 512
#: The default schedules, by a source's turn: weights at even steps of training time, each with the same integral.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_count(text: Column) -> Column:
    """Number of runs outside ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """(source, source_size, turn, weight, target) out of (source, source_size).

    Sources stand by code point, null last, and weigh 1, 2, 3, repeating, unless
    ``weight`` says otherwise. Together they share all words by weight; a target
    stops at ``most`` times its source's size and the excess is shared again
    among the rest, until none is above. A source is full when size * most /
    weight is at most the level at which the rest would share; ordering sources
    by that ratio finds the level in one pass of running sums, in two levels, so
    sources may be many. One row a source; sizes are not null, an empty frame
    gives an empty one.
    """
    t = numbered(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"]).withColumnRenamed("__nth", "turn")
    t = t.withColumn("weight", (F.col("turn") % 3 + 1).cast("double") if weight is None else weight.cast("double"))
    t = t.withColumn("cap", F.lit(most).cast("long") * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = numbered(t, ["ratio", "turn"], ("cap", "weight"))
    every = t.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    t = t.crossJoin(F.broadcast(every)).withColumn("level", (F.col("all_words") - F.col("__before_cap")) / (F.col("all_weight") - F.col("__before_weight")))
    t = saved(t.select("source", "source_size", "turn", "weight", "cap", "ratio", "level"), "levels")
    # the level of the first source that isn't full holds for it and all after it
    level = t.filter("ratio > level").agg(F.min_by("level", F.struct("ratio", "turn")).alias("at"))
    target = F.when(F.col("ratio") <= F.coalesce("at", F.lit(float("inf"))), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("at"))
    return t.crossJoin(F.broadcast(level)).select("source", "source_size", "turn", "weight", target.alias("target"))


def _position(done: Column, target: Column, knots: Column) -> Column:
    """Training time in [0, 1] at which a source's cumulative demand reaches ``done`` words.

    ``knots`` are its schedule's weights at even steps; over a step the demand
    grows by a trapezoid, inside it by a parabola that is solved for its root.
    """
    steps = F.size(knots) - 1
    area = F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda a, i: a + (F.element_at(knots, i) + F.element_at(knots, i + 1)) / 2)
    want = F.when(target > 0, done / target).otherwise(F.lit(0.0)) * area

    def step(state, i):
        a, b = F.element_at(knots, i), F.element_at(knots, i + 1)
        trapezoid = (a + b) / 2
        here = (state["t"] < 0) & ((state["left"] <= trapezoid) | (i == steps))
        root = F.sqrt(F.greatest(a * a + 2 * (b - a) * state["left"], F.lit(0.0)))
        inside = F.when(a + root > 0, F.least(2 * state["left"] / (a + root), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.struct(F.when(here, (i - 1 + inside) / steps).otherwise(state["t"]).alias("t"), F.when(state["t"] < 0, state["left"] - trapezoid).otherwise(state["left"]).alias("left"))

    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(-1.0).alias("t"), want.cast("double").alias("left")), step)["t"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules=SCHEDULES, seed: int = 23) -> DataFrame:
    """One row per document: __id, __source, __key, size, source_size, target, taken, and copies.

    ``copies`` are structs (position, words): each time the mix takes the
    document, when, and how many of its words. Whole passes take all words; the
    last copy at a source's target takes the words that the target still has
    room for, so a source's taken words are its target rounded down.

    A null text has no words and is never taken; null sources form one source,
    the last; a null id is kept. Repeated rows count each. Words that several
    equal rows share are dealt out among them in an arbitrary but whole manner.
    Reruns agree. Extra columns are ignored, whatever their names; an empty
    table gives an empty frame.
    """
    c = lambda n: F.col(f"`{n}`")
    rows = docs.select(c(id_col).alias("__id"), c(source_col).cast("string").alias("__source"), word_count(c(text_col)).alias("size"), F.xxhash64(c(id_col), c(text_col), F.lit(seed)).alias("__order"), row_key(id_col, text_col).alias("__key"))
    rows = saved(rows, "sizes")
    by_source = rows.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    buckets = max(1, -(-(by_source.agg(F.max("n")).first()[0] or 1) // BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.floor((F.col("__order").cast("double") / 2.0**64 + 0.5) * buckets).cast("int"))
    plan = targets(by_source.select(F.col("__source").alias("source"), "source_size"))
    knots = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    plan = plan.withColumn("knots", F.element_at(knots, (F.col("turn") % len(schedules) + 1).cast("int")))
    sums = rows.groupBy("__source", "__bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    plan = sums.join(plan, sums["__source"].eqNullSafe(plan["source"])).select(sums["__source"].alias("s"), F.col("__bucket").alias("b"), "base", "source_size", "target", "knots")
    plan = saved(plan, "mix-plan")
    joined = rows.join(plan, rows["__source"].eqNullSafe(plan["s"]) & (rows["__bucket"] == plan["b"])).drop("s", "b")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "size", "__key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    out = joined.withColumn("__before", before)
    total, size = F.floor("target").cast("long"), F.col("size")
    # copy p of a document takes the words [p * source_size + before, ... + size) of the source's line, up to the target
    passes = F.sequence(F.lit(0), F.greatest(F.coalesce(F.ceil(F.col("target") / F.nullif("source_size", F.lit(0))).cast("int"), F.lit(0)) - 1, F.lit(0)))
    copies = F.transform(passes, lambda p: F.struct((p * F.col("source_size") + F.col("__before")).alias("at"), F.greatest(F.lit(0), F.least(size, total - p * F.col("source_size") - F.col("__before"))).alias("words")))
    copies = F.filter(copies, lambda x: x["words"] > 0)
    placed = F.transform(copies, lambda x: F.struct(_position(x["at"].cast("double"), F.col("target"), F.col("knots")).alias("position"), x["words"].alias("words")))
    return out.select("__id", "__source", "__key", "size", "source_size", "target", F.aggregate(copies, F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), placed.alias("copies"))


def schedule(mixed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The copies of a mix in training order: position, __key, __id, words, size and the columns ``keep``; range-sorted, ties by key and copy."""
    own = ["__id", "__key", "size", *keep]
    rows = mixed.select(*own, F.posexplode("copies").alias("copy", "c")).select(*own, "copy", "c.position", "c.words")
    by = ["position", "__key", "copy"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def places(mixed: DataFrame) -> DataFrame:
    """``mixed`` with positions and places of each document's copies in the schedule, by copy.

    A place counts the copies that come before in training order, from 0: those
    of earlier ranges, by prefix sums over one row a range, and those before it
    in its own. A document that isn't taken has empty arrays.
    """
    mixed = saved(mixed.withColumn("__row", F.monotonically_increasing_id()), "mix")
    rows = saved(schedule(mixed, ("__row",)).withColumn("__at", F.monotonically_increasing_id()), "schedule")
    rows = rows.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})  # Spark's layout: partition, row
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(bases), "__part").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("copy", "position", (F.col("base") + F.col("__at")).alias("place")))).alias("c"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = mixed.join(rows, "__row", "left")
    return out.withColumns({"positions": F.coalesce("c.position", none("double")), "places": F.coalesce("c.place", none("bigint"))}).drop("__row", "c")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order, with the columns of ``docs``.

    The copy that reaches a source's target is cut after the words taken, so that
    each source has its target's words; all other copies are whole.

    Null, empty and blank texts have no words and are never taken; null sources
    are one source and null ids are kept. A very long text is one document. Rows
    equal in id and text count each, and one stands for all. Ties in position go
    by a key of id and text. Extra columns may have any names; an empty table
    gives an empty frame.
    """
    mixed = mix(docs, id_col, text_col, source_col, **how)
    key, size, copy = (free_name(docs, x) for x in ("__k", "__size", "__copy"))
    taken = mixed.select(F.col("__key").alias(key), F.col("size").alias(size), F.explode("copies").alias(copy))
    text = F.col(f"`{text_col}`")
    rows = docs.withColumn(key, row_key(id_col, text_col))
    if not mixed.groupBy("__key").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates([key])  # equal rows: one stands for all, as all their copies carry its key
    by = [F.col(f"{copy}.position"), F.col(key), F.col(f"{copy}.words")]
    rows = rows.join(taken, key).repartitionByRange(*by).sortWithinPartitions(*by)
    # possessive, so that Java's matcher loops instead of recursing
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col(f"{copy}.words").cast("string"), F.lit("}+"))
    cut = F.when(F.col(f"{copy}.words") < F.col(size), F.regexp_substr(text, pattern)).otherwise(text)
    return rows.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark, sf_dir):
    """Contract query: all documents, sources weighing 1, 2, 3 in turn, with each copy's position and place in the training order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = places(mix(docs))
    return m.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("copies").alias("copies"), "positions", "places")
