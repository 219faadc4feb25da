"""Traversal: simple paths, closures, components, ranks, causal walks, counterfactuals.

Iteration is a driver loop over joins. Each level's frontier is saved in the
shared folder, so a level costs one join whatever the depth, lineage stays short
and a lost executor costs a level at most. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import temporal as tm
from tempora.operators.select import path_depth
from tempora.tables import discard, new_path, saved


def edges(assertions: DataFrame) -> DataFrame:
    """Assertions between entities: (id, subject, predicate, object, ...)."""
    return assertions.filter("obj_kind = 'Entity'").withColumnRenamed("obj_entity", "object")


def _condition(valid_at: int | None, min_confidence: float | None, during: tuple[int, int | None] | None, predicates: list[str] | None) -> Column:
    asked = []
    if predicates:
        asked.append(F.col("predicate").isin(predicates))
    if valid_at is not None:
        asked.append(tm.valid_at(valid_at))
    if during is not None:
        asked.append(tm.overlaps("valid_from", "valid_to", F.lit(during[0]), F.lit(during[1]).cast("long")))
    if min_confidence is not None:
        asked.append(F.col("confidence") >= min_confidence)
    return tm.all_of(asked)


def paths(edge: DataFrame, starts: DataFrame, depth: int, end: str | None = None, predicates: list[str] | None = None, positional: bool = True, stop_at_end: bool = False, valid_at: int | None = None, min_confidence: float | None = None, during=None) -> DataFrame:
    """(start, end, hops, entities, length): all simple paths of up to ``depth`` hops from ``starts`` (id).

    ``predicates``: the i-th hop has the i-th of them, and there are no more hops
    than that; or, not ``positional``, each hop has one of them. Paths that reach
    ``end`` are results and go on past it unless ``stop_at_end``. Status isn't
    looked at. ``during``: every hop overlaps that window.
    """
    depth = path_depth(depth)
    if positional and predicates:
        depth = min(depth, len(predicates))
    e = edge.filter(_condition(valid_at, min_confidence, during, predicates)).select("subject", "object", F.col("id").alias("hop"), "predicate")
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<string>").alias("hops"), F.array("id").alias("entities")).distinct()
    levels = []
    for d in range(depth):
        step = e.filter(F.col("predicate") == predicates[d]) if positional and predicates else e
        grown = now.join(step, now["at"] == step["subject"]).filter(~F.array_contains("entities", F.col("object")))
        now = grown.select("start", F.col("object").alias("at"), F.concat("hops", F.array("hop")).alias("hops"), F.concat("entities", F.array("object")).alias("entities"))
        if d < depth - 1:
            now = saved(now, "paths")
        levels.append(now)
        if stop_at_end and end is not None:
            now = now.filter(F.col("at") != end)
    out = levels[0] if levels else now.limit(0)
    for level in levels[1:]:
        out = out.union(level)
    if end is not None:
        out = out.filter(F.col("at") == end)
    return out.select("start", F.col("at").alias("end"), "hops", "entities", F.size("hops").alias("length"))


def _levels(first: DataFrame, e: DataFrame, keys: list[str], depth: int | None) -> DataFrame:
    """``first`` (keys, depth; one depth) and what its nodes reach over saved edges (a, b), level by level until one finds nothing new.

    A level is a part of its own that is written once; all parts are read as one
    scan, so nothing that was found is written again and a plan stays short
    however deep the graph is.
    """
    path, spark = new_path(e.sparkSession, "levels"), e.sparkSession
    schema = first.schema
    part = lambda d: f"{path}/level-{d:06d}"
    first.write.parquet(part(0))
    frontier, parts = spark.read.schema(schema).parquet(part(0)), [part(0)]
    done = 0
    while (depth is None or done < depth) and not frontier.isEmpty():
        done += 1
        step = frontier.join(e, frontier["node"] == e["a"]).select(*[F.col("b").alias("node") if k == "node" else F.col(k) for k in keys], F.col("depth") + 1).toDF(*keys, "depth").distinct()
        seen = spark.read.schema(schema).parquet(*parts)
        step.join(seen.select(*keys), keys, "left_anti").select(*schema.names).write.parquet(part(done))
        frontier = spark.read.schema(schema).parquet(part(done))
        parts.append(part(done))
    return spark.read.schema(schema).parquet(*parts)


def reachable(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): what each root (id) reaches over (a, b), at its least depth, however deep.

    The root isn't seeded: it is among its own results only if a cycle leads
    back. The loop ends when a level finds nothing new.
    """
    e = saved(pairs.select("a", "b").distinct(), "edges")
    first = roots.select(F.col("id").alias("root")).distinct().join(e, F.col("root") == e["a"]).select("root", F.col("b").alias("node")).distinct()
    return _levels(first.withColumn("depth", F.lit(1)), e, ["root", "node"], None)


def bfs(pairs: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """(node, depth): least number of hops from any of several roots, which have depth 0; with a depth of None, however far."""
    e = saved(pairs.select("a", "b").distinct(), "edges")
    return _levels(roots.select(F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)), e, ["node"], depth)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a")
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is its component's least node.

    Alternating large-star and small-star steps: a logarithmic number of rounds,
    and a node with very many edges never has them in one task.
    """

    def state(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    e = saved(pairs.select("a", "b").filter("a is not null and b is not null and a != b").distinct(), "links")
    was = state(e)
    while was[0]:
        old, e = e, saved(_small_star(_large_star(e)), "stars")
        discard(old)
        now = state(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def personalized_page_rank(pairs: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 16, tolerance: float = 1e-5) -> DataFrame:
    """(node, score): ranks with restart at ``seeds`` (id, weight); what nodes without edges hold goes back to the seeds.

    Starts from the seeds' normalized weights; ends after ``rounds`` or when the
    sum of changes is within the tolerance.
    """
    e = saved(pairs.select("a", "b").distinct(), "edges")
    out = e.groupBy("a").agg(F.count("*").alias("n"))
    total = seeds.agg(F.sum("weight").alias("w")).first()["w"]
    teleport = seeds.groupBy(F.col("id").alias("node")).agg((F.sum("weight") / total).alias("t"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).union(teleport.select("node")).distinct()
    nodes = saved(nodes.join(teleport, "node", "left").join(out.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("n", F.lit(0)).alias("n")), "nodes")
    ranks = nodes.select("node", F.col("t").alias("score"))
    for _ in range(rounds):
        had = nodes.join(ranks, "node")
        held = had.agg(F.sum(F.when(F.col("n") == 0, F.col("score")).otherwise(0.0)).alias("h")).first()["h"] or 0.0
        given = had.filter("n > 0 and score > 0").select(F.col("node").alias("a"), (F.col("score") / F.col("n")).alias("g")).join(e, "a").groupBy(F.col("b").alias("node")).agg(F.sum("g").alias("g"))
        new = had.join(given, "node", "left").select("node", "score", ((1 - damping + damping * held) * F.col("t") + damping * F.coalesce("g", F.lit(0.0))).alias("next"))
        new = saved(new, "ranks")
        moved = new.agg(F.sum(F.abs(F.col("next") - F.col("score"))).alias("d")).first()["d"]
        ranks = new.select("node", F.col("next").alias("score"))
        if (moved or 0.0) <= tolerance:
            break
    return ranks


def causal_paths(links: DataFrame, events: DataFrame, depth: int, reverse: bool = False, rule: str = "product", min_link: float = 0.0) -> DataFrame:
    """(start, end, path, length, confidence): simple causal paths from ``events`` (id), or leading to them.

    ``links``: cause, effect, pct. ``rule``: how links' confidences make the
    path's: ``product`` rounded to two places, ``raw`` product, or ``min``.
    """
    a, b = ("effect", "cause") if reverse else ("cause", "effect")
    e = links.filter(F.col("pct") >= min_link * 100).select(F.col(a).alias("x"), F.col(b).alias("y"), "pct")
    now = events.select(F.col("id").alias("origin"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("c"))
    levels = []
    for d in range(depth):
        grown = now.join(e, now["at"] == e["x"]).filter(~F.array_contains("nodes", F.col("y")))
        now = grown.select("origin", F.col("y").alias("at"), (F.concat(F.array("y"), F.col("nodes")) if reverse else F.concat(F.col("nodes"), F.array("y"))).alias("nodes"), F.concat("c", F.array(F.col("pct").cast("bigint"))).alias("c"))
        if d < depth - 1:
            now = saved(now, "causal")
        levels.append(now)
    out = levels[0] if levels else now.limit(0)
    for level in levels[1:]:
        out = out.union(level)
    # whole percents, divided once at the end: exact for up to nine links
    product = F.aggregate("c", F.lit(1).cast("decimal(38,0)"), lambda acc, x: (acc * x).cast("decimal(38,0)")).cast("double") / F.pow(F.lit(100.0), F.size("c"))
    confidence = {"product": F.round(product, 2), "raw": product, "min": F.array_min("c") / 100}[rule]
    ends = (F.col("at"), F.col("origin")) if reverse else (F.col("origin"), F.col("at"))
    return out.select(ends[0].alias("start"), ends[1].alias("end"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("path"), F.size("c").alias("length"), confidence.alias("confidence"))


def remove_event(links: DataFrame, event: DataFrame, depth: int) -> DataFrame:
    """(node, side, depth): the cone of an event (id) that did not happen: what it caused and what led to it."""
    down = reachable_within(links.select(F.col("cause").alias("a"), F.col("effect").alias("b")), event, depth).withColumn("side", F.lit("downstream"))
    up = reachable_within(links.select(F.col("effect").alias("a"), F.col("cause").alias("b")), event, depth).withColumn("side", F.lit("upstream"))
    return down.union(up)


def reachable_within(pairs: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth) without the roots, at most ``depth`` hops away."""
    return bfs(pairs, roots, depth).filter("depth > 0")


def affected_paths(assertions: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """Undirected simple paths of active assertions from changed entities (id), no entity or assertion twice."""
    e = edges(assertions.filter("status = 'Active'")).select("id", "subject", "predicate", "object", "valid_from", "valid_to", "confidence")
    both = e.union(e.select("id", F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"), "valid_from", "valid_to", "confidence"))
    return paths(both, changed, depth)


def shortest_distance(pairs: DataFrame, start: DataFrame, end: str, depth: int) -> DataFrame:
    return bfs(pairs, start, depth).filter(F.col("node") == end)


def community_summary(assertions: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a component: how many entities, assertions and sources, and its time: latest start, earliest end.

    The two ends may be inverted; both are given as they are.
    """
    size = roots.groupBy("root").agg(F.count("*").alias("entities"))
    of = assertions.join(roots.withColumnRenamed("node", "subject"), "subject")
    t = of.groupBy("root").agg(F.count("*").alias("assertions"), F.max("valid_from").alias("valid_start"), F.min("valid_to").alias("valid_end"), F.max("tx_from").alias("tx_start"), F.min("tx_to").alias("tx_end"))
    s = of.select("root", F.explode("source_ids").alias("s")).distinct().groupBy("root").agg(F.count("*").alias("sources"))
    return size.join(t, "root", "left").join(s, "root", "left")


def component_of(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of everything connected with the seeds (id), themselves included: only their components are walked.

    A node is met once, whichever seed it is met from: seeds may be as many as nodes.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    return bfs(both, seeds, None).select("node").distinct()


def recompute_affected(assertions: DataFrame, roots: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, root): components after a change, computed anew for the components the changed entities (id) touch or now join, the rest as they were."""
    e = edges(assertions).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    old = roots.join(changed.withColumnRenamed("id", "node"), "node", "left_semi").select("root").distinct()
    touched = roots.join(old, "root", "left_semi").select(F.col("node").alias("id")).union(changed.select("id")).distinct()
    inside = component_of(e, touched)
    part = e.join(inside.withColumnRenamed("node", "a"), "a", "left_semi")
    return roots.join(inside, "node", "left_anti").select("node", "root").union(components(part))


def shortest_paths(pairs: DataFrame, starts: DataFrame, end: str, depth: int) -> DataFrame:
    """(nodes, length): the first of the shortest paths, by nodes, from any start (id) to the end."""
    levels = bfs(pairs, starts, depth)
    e = saved(pairs.select("a", "b").distinct(), "edges")
    length = levels.filter(F.col("node") == end).select("depth").first()
    if length is None:
        return starts.sparkSession.createDataFrame([], "nodes array<string>, length int")
    back = starts.sparkSession.createDataFrame([(end, [end])], "at string, nodes array<string>")
    for d in range(length["depth"] - 1, -1, -1):
        step = back.join(e, back["at"] == e["b"]).join(levels.filter(F.col("depth") == d), F.col("a") == F.col("node"))
        back = step.select(F.col("a").alias("at"), F.concat(F.array("a"), F.col("nodes")).alias("nodes")).groupBy("at").agg(F.min("nodes").alias("nodes"))
    return back.agg(F.min("nodes").alias("nodes")).select("nodes", F.lit(length["depth"]).alias("length"))


def confidence_deltas(impacted: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, before, after, delta): what rules (predicate, delta) do to the confidence of impacted assertions, held in [0, 1]."""
    by = rules.groupBy("predicate").agg(F.sum("delta").alias("d"))
    after = F.least(F.greatest(F.col("confidence") + F.col("d"), F.lit(0.0)), F.lit(1.0))
    return impacted.join(by, "predicate").select("id", F.col("confidence").alias("before"), after.alias("after"), (after - F.col("confidence")).alias("delta"))
