"""What agents ask of the graph: remember, explain, simulate, choose tools, share answers, and the environment they are trained in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm
from tempora.operators import graph as gx
from tempora.operators import judge as jx
from tempora.operators.context import narrative

#: What an action earns.
REWARDS = {"correct": 1.0, "cited_source": 0.25, "wrote_memory": 0.35, "trusted_false": -1.2, "delayed": 0.05, "investigated": 0.5}
DELAY = 2  # steps after which a consequence takes place


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """``memories`` with ``new`` ones (id, agent_id, conv_id, content, valid_from) appended: active, open-ended; each has a source (source_id), or reading raises."""
    sourced = F.when(F.col("source_id").isNull(), F.raise_error(F.concat(F.lit("a memory without a source: "), F.col("id")))).otherwise(F.col("id"))
    rows = new.select(sourced.alias("id"), "agent_id", "conv_id", "content", "valid_from", F.lit(None).cast("long").alias("valid_to"), F.lit("Active").alias("status"))
    return memories.unionByName(rows)


def explain(pack_assertions: DataFrame, names: DataFrame) -> DataFrame:
    """(subject, text): each assertion of an evidence pack with its object, confidence and sources, a line each, by id."""
    named = pack_assertions.join(names.select(F.col("id").alias("subject"), "canonical_name"), "subject", "left")
    line = F.concat(F.coalesce("canonical_name", "subject"), F.lit(" "), F.col("predicate"), F.lit(" "), F.coalesce("obj_text", "obj_entity"), F.lit(" ("), F.col("pct").cast("string"), F.lit("%, "), F.array_join("source_ids", ", "), F.lit(")"))
    return narrative(named, ["subject"], line, ["id"])


def verified_answers(answers: DataFrame, assertions: DataFrame) -> DataFrame:
    """``answers`` (answer_id, text, supporting_id) with verified: whether the supporting assertion exists, is active and names a source."""
    ok = assertions.filter((F.col("status") == "Active") & (F.size("source_ids") > 0)).select(F.col("id").alias("supporting_id")).distinct().withColumn("verified", F.lit(True))
    return answers.join(ok, "supporting_id", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def simulate(actions: DataFrame, assertions: DataFrame, memories: DataFrame, links: DataFrame, governed: DataFrame, required: DataFrame) -> DataFrame:
    """One row an action (action_id, agent_id, target, event_id, sensitivity): counts of what bears on it, risk, level and advice.

    memories: what the agent remembers; effects: events that its event may cause
    in two steps; missing: predicates (action_id, predicate) that its target has
    no assertion of; violations: the target's assertions that governance
    (``governed``: the permitted ones) withholds, looked at for high sensitivity.
    """
    count = lambda df, name: df.groupBy("action_id").agg(F.count("*").alias(name))
    own = count(actions.join(memories.filter("status = 'Active'").select("agent_id"), "agent_id"), "memories")
    one = links.select(F.col("cause").alias("event_id"), F.col("effect"))
    first = actions.select("action_id", "event_id").join(one, "event_id")
    both = first.select("action_id", "effect").union(first.select("action_id", F.col("effect").alias("event_id")).join(one, "event_id").select("action_id", "effect")).distinct()
    about = actions.select("action_id", "sensitivity", F.col("target").alias("subject")).join(assertions.select("id", "subject", "predicate"), "subject")
    missing = count(required.join(about.select("action_id", "predicate").distinct(), ["action_id", "predicate"], "left_anti"), "missing")
    held = count(about.filter("sensitivity = 'High'").join(governed.select("id"), "id", "left_anti"), "violations")
    out = actions
    for part in (own, count(both, "effects"), missing, held):
        out = out.join(part, "action_id", "left")
    out = out.fillna(0, ["memories", "effects", "missing", "violations"])
    risk, level, advice = jx.assess_action(F.col("sensitivity"), F.col("memories"), F.col("effects"), F.col("missing"), F.col("violations"))
    return out.withColumns({"risk": risk, "level": level, "advice": advice})


def choose_tool(question: Column, has_evidence: Column, tools: Column) -> Column:
    """The tool that a question calls for, if it is among the candidates, else their first."""
    q = fx.ascii_lower(question)
    wanted = F.when(q.contains("verify") | has_evidence, "verify_claim").when(q.contains("memory"), "write_memory").otherwise("send_email")
    return F.when(F.array_contains(tools, wanted), wanted).otherwise(F.get(tools, F.lit(0)))


def recommend_tools(gaps: DataFrame, tools: DataFrame) -> DataFrame:
    """(tool, urgency, gaps, risk): for each gap (gap_id, predicate, suggested, urgency, risk) the tool it names, else the first by order that serves its predicate.

    tools: tool, nth, predicates. Most urgent first, then by name.
    """
    named = gaps.join(tools.select(F.col("tool").alias("suggested"), F.col("tool").alias("by_name")), "suggested", "left")
    serves = tools.select(F.explode("predicates").alias("predicate"), "tool", "nth").groupBy("predicate").agg(F.min_by("tool", "nth").alias("by_predicate"))
    found = named.join(serves, "predicate", "left").withColumn("tool", F.coalesce("by_name", "by_predicate")).filter("tool is not null")
    return found.groupBy("tool").agg(F.max("urgency").alias("urgency"), F.count_distinct("gap_id").alias("gaps"), F.max("risk").alias("risk")).orderBy(F.desc("urgency"), "tool")


def resolve_aliases(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """(alias, canonical, member): the cluster of each wanted alias (alias): its canonical id, and all ids of that."""
    own = wanted.select("alias").distinct().join(aliases.select("alias", "canonical"), "alias")
    return own.join(aliases.select("canonical", F.col("alias").alias("member")), "canonical").select("alias", "canonical", "member")


def shared_answers(entries: DataFrame) -> DataFrame:
    """(entry, with): cached answers by the least entry that they can be shared with: equal key, tenant and policy epoch, nulls included."""
    least = entries.groupBy("key", "tenant", "epoch").agg(F.min("entry").alias("with"))
    on = [entries[c].eqNullSafe(least[c]) for c in ("key", "tenant", "epoch")]
    return entries.join(least, on).select(entries["entry"], least["with"])


def keys_valid_at(windows: DataFrame, t: int) -> DataFrame:
    """(key) of cached answers whose window of valid time holds t."""
    return windows.filter(tm.valid_at(t)).select("key").distinct()


def reward_for(cites_true: Column, cites_false: Column, cites_source: Column, wrote_memory: Column, delayed: Column, investigated: Column) -> Column:
    """What an action earns, from what it did."""
    parts = ((cites_true, "correct"), (cites_source, "cited_source"), (wrote_memory, "wrote_memory"), (cites_false, "trusted_false"), (delayed, "delayed"), (investigated, "investigated"))
    return sum((F.when(did, REWARDS[name]).otherwise(0.0) for did, name in parts), F.lit(0.0))


def consequences(steps: DataFrame, delay: int = DELAY) -> DataFrame:
    """(episode, step, due): delayed consequences of steps (episode, step, delayed), by the step at which they take place, if the episode gets there."""
    last = steps.groupBy("episode").agg(F.max("step").alias("last"))
    due = steps.filter("delayed").select("episode", "step", (F.col("step") + delay).alias("due"))
    return due.join(last, "episode").filter("due <= last").select("episode", "step", "due")


# worlds that are not: interventions on the graph


def evaluate(assertions: DataFrame, changed: DataFrame, rules: DataFrame, depth: int, valid_at: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, impacted, deltas) of an intervention that changes entities (id): paths from them, the assertions on these, what rules (predicate, delta) do to them."""
    now = assertions if valid_at is None else assertions.filter(tm.valid_at(valid_at))
    found = gx.affected_paths(now, changed, depth)
    impacted = assertions.join(found.select(F.explode("hops").alias("id")).distinct(), "id", "left_semi")
    return found, impacted, gx.confidence_deltas(impacted, rules)


def add_event(events: DataFrame) -> DataFrame:
    """(event_id, kind, target) of hypothetical events (event_id, entities, assertions): what they name, without any traversal."""
    of = lambda c, kind: events.select("event_id", F.lit(kind).alias("kind"), F.explode(c).alias("target"))
    return events.select("event_id", F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("target")).union(of("entities", "entity")).union(of("assertions", "assertion")).distinct()


def disable_link(links: DataFrame, cause, effect, depth: int) -> DataFrame:
    """(node, depth): what the cause no longer reaches within ``depth`` steps once its link to the effect is gone; other ways keep a node."""
    pairs = links.select(F.col("cause").alias("a"), F.col("effect").alias("b"))
    root = links.sparkSession.createDataFrame([(cause,)], "id bigint")
    without = pairs.filter((F.col("a") != cause) | (F.col("b") != effect))
    return gx.reachable_within(pairs, root, depth).join(gx.reachable_within(without, root, depth).select("node"), "node", "left_anti")
