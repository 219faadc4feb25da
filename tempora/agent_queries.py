"""Registered queries over atoms, agents, worlds that are not, judging, text functions and the log, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm
from tempora.operators import activation as ac
from tempora.operators import agents as ag
from tempora.operators import aggregates as ax
from tempora.operators import belief as bx
from tempora.operators import context as ct
from tempora.operators import contradictions as cx
from tempora.operators import evaluate as el
from tempora.operators import events as ev
from tempora.operators import evidence as pk
from tempora.operators import graph as gx
from tempora.operators import judge as jx
from tempora.operators import kernel as kx
from tempora.operators import maintenance as mt
from tempora.operators import memory as mx
from tempora.operators import ontology as on
from tempora.operators import retrieval as rx
from tempora.operators import select as sx
from tempora.operators import sharing as sh
from tempora.operators import vm
from tempora.plans import lang
from tempora.queries import CONFLICTS, ENTITIES, HOPS, LINKS, LOCATED, PLACED, REGIONS, SHOWN, SOURCES, STATE, SUPPLIED, V, _regions, query
from tempora.sources import exports as xp
from tempora.sources import ingest as ig
from tempora.sources.graph import Graph

_SHOWN = SHOWN.split(", ")

# atoms: events as claims of several kinds; a source, and a summary for each user, that depend on them

ATOMS = """atoms AS (
  SELECT id AS atom_id, subject, obj_text AS object, valid_from, valid_to, tx_from, tx_to, pct, source, coalesce(context, 'public') AS permission,
    CASE WHEN status = 'Active' THEN CASE WHEN tx_from % 17 = 0 THEN 'Disputed' WHEN tx_from % 19 = 0 THEN 'Candidate' ELSE 'Accepted' END ELSE 'Retracted' END AS belief,
    CASE tx_from % 7 WHEN 1 THEN 'AgentMemory' WHEN 2 THEN 'Hypothesis' ELSE 'Observation' END AS claim_type,
    CASE WHEN tx_from % 13 = 0 THEN 'Forbidden' ELSE 'Allowed' END AS ai_usage, CASE WHEN tx_from % 11 = 0 THEN 'Untrusted' END AS taint, tx_from % 4 <> 0 AS evident FROM state)"""
FOR_AI = "belief IN ('Accepted', 'Disputed') AND evident AND ai_usage <> 'Forbidden' AND claim_type <> 'Hypothesis' AND taint IS NULL"


def _machine(g: Graph) -> vm.Machine:
    s, i = g.state(), F.col("tx_from")
    belief = F.when(F.col("status") == "Active", F.when(i % 17 == 0, "Disputed").when(i % 19 == 0, "Candidate").otherwise("Accepted")).otherwise("Retracted")
    atoms = s.select(
        F.col("id").alias("atom_id"), "subject", "predicate", F.col("obj_text").alias("object"), "valid_from", "valid_to", "tx_from", "tx_to", "pct", "confidence", belief.alias("belief"),
        F.when(i % 7 == 1, "AgentMemory").when(i % 7 == 2, "Hypothesis").otherwise("Observation").alias("claim_type"), F.when(i % 13 == 0, "Forbidden").otherwise("Allowed").alias("ai_usage"), F.when(i % 11 == 0, "Untrusted").alias("taint"),
        F.coalesce("context", F.lit("public")).alias("permission"), F.col("subject").alias("agent"), F.coalesce("context", F.lit("public")).alias("tenant"), F.col("source_ids").alias("sources"), F.when(i % 4 != 0, F.array("id")).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
    revisions = atoms.filter("tx_to is not null").select("atom_id", F.lit(1).alias("seq"), F.col("tx_to").alias("known_at"), F.lit("Accepted").alias("previous"), F.lit("Retracted").alias("next"))
    deps = atoms.select(F.col("atom_id").alias("from_id"), F.col("sources")[0].alias("to_id"), F.lit("DerivedFrom").alias("kind")).union(atoms.select(F.concat(F.lit("summary-"), "subject"), "atom_id", F.lit("SummaryOf")))
    return vm.Machine(atoms, revisions, deps, g.causal_links())


@query(f"SELECT atom_id FROM atoms WHERE {FOR_AI}", STATE, ATOMS)
def atoms_for_ai(g: Graph) -> DataFrame:
    return _machine(g).atoms.filter(kx.supported_for_ai()).select("atom_id")


@query(f"SELECT atom_id, belief FROM atoms WHERE valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= 9000 AND (tx_to IS NULL OR tx_to > 9000) AND permission IN ('public', 'tenant:1')", STATE, ATOMS)
def atoms_visible(g: Graph) -> DataFrame:
    """Visible atoms with the permissions of tenant 1."""
    return kx.visible(_machine(g).atoms, V, 9000).filter(F.col("permission").isin("public", "tenant:1")).select("atom_id", "belief")


@query("SELECT belief, count(*) AS n FROM atoms WHERE belief IN ('Accepted', 'Disputed') GROUP BY 1", STATE, ATOMS)
def beliefs_by_state(g: Graph) -> DataFrame:
    return kx.beliefs_by_state(_machine(g).atoms, "IncludeDisputed")


@query(f"SELECT atom_id, CASE WHEN tx_to > 9800 THEN 'Accepted' ELSE belief END AS belief_then FROM atoms WHERE subject = 'user-9' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= 9800 AND (tx_to IS NULL OR tx_to > 9800) AND {FOR_AI}", STATE, ATOMS)
def vm_true_at(g: Graph) -> DataFrame:
    return _machine(g).run(vm.Question("WhatWasTrueAt", entity="user-9", valid_at=V, known_at=9800, ai_facing=True)).select("atom_id", "belief_then")


@query("SELECT 'state-10' AS atom_id, tx_to AS known_at, 'Accepted' AS previous, 'Retracted' AS next FROM state WHERE id = 'state-10'", STATE)
def vm_belief_changes(g: Graph) -> DataFrame:
    return _machine(g).run(vm.Question("WhenDidBeliefChange", target="state-10")).select("atom_id", "known_at", "previous", "next")


COLLAPSES = "SELECT 'source-11' AS root, atom_id AS node, 1 AS depth, 'state' AS kind FROM atoms WHERE source = 'source-11' UNION ALL SELECT DISTINCT 'source-11', 'summary-' || subject, 2, 'summary' FROM atoms WHERE source = 'source-11'"


@query(COLLAPSES, STATE, ATOMS)
def vm_source_false(g: Graph) -> DataFrame:
    return _machine(g).run(vm.Question("IfSourceFalseWhatCollapses", target="source-11"))


@query(COLLAPSES, STATE, ATOMS)
def native_what_breaks(g: Graph) -> DataFrame:
    return _machine(g).native(vm.Native("WhatBreaksIfFalse", target="source-11"))


@query(f"SELECT atom_id FROM atoms WHERE object = 'purchase' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND permission IN ('public', 'tenant:2') AND {FOR_AI}", STATE, ATOMS)
def native_verify(g: Graph) -> DataFrame:
    return _machine(g).native(vm.Native("VerifyClaim", predicate="STATE", obj="purchase", valid_at=V, labels=["public", "tenant:2"], ai_facing=True)).select("atom_id")


@query("""SELECT start, "end", path, length, confidence FROM w""", LINKS, """w AS (
  SELECT cause AS start, effect AS "end", cause || '>' || effect AS path, 1 AS length, pct / 100.0::DOUBLE AS confidence FROM links WHERE cause = 500
  UNION ALL SELECT w.start, l.effect, w.path || '>' || l.effect, w.length + 1, least(w.confidence, l.pct / 100.0::DOUBLE) FROM w JOIN links l ON l.cause = w."end" WHERE w.length < 3)""", recursive=True)
def native_effects(g: Graph) -> DataFrame:
    return _machine(g).native(vm.Native("CausalEffects", target=500, depth=3))


@query("SELECT node, depth FROM d WHERE depth > 0", LINKS, "d AS (SELECT CAST(500 AS BIGINT) AS node, 0 AS depth UNION SELECT l.effect, d.depth + 1 FROM d JOIN links l ON l.cause = d.node WHERE d.depth < 2)", recursive=True)
def vm_breaks_without_event(g: Graph) -> DataFrame:
    return _machine(g).run(vm.Question("WhatBreaksIfEventDoesNotOccur", target=500, depth=2))


@query("SELECT atom_id, CASE WHEN belief = 'Accepted' AND object = 'error' AND CAST(substr(subject, 6) AS BIGINT) % 2 = 0 THEN 'Disputed' ELSE belief END AS belief FROM atoms", STATE, ATOMS)
def atoms_in_conflict(g: Graph) -> DataFrame:
    """Errors of one user are in conflict; those of users with an odd number are resolved."""
    atoms = _machine(g).atoms
    c = atoms.filter("object = 'error'").groupBy("subject").agg(F.collect_list("atom_id").alias("atom_ids"))
    c = c.select(F.col("subject").alias("conflict_id"), "atom_ids", F.when(F.substring("subject", 6, 20).cast("long") % 2 == 0, "Open").otherwise("Resolved").alias("status"))
    return kx.add_conflicts(atoms, c)[0].select("atom_id", "belief")


@query("SELECT atom_id FROM atoms WHERE source = 'source-11'", STATE, ATOMS)
def retraction_propagates(g: Graph) -> DataFrame:
    m = _machine(g)
    return kx.retract(m.atoms, m.deps, g.spark.createDataFrame([("source-11",)], "id string")).filter("invalidated").select("atom_id")


@query("SELECT 'summary-' || subject AS from_id, atom_id AS to_id FROM atoms WHERE permission <> 'public'", STATE, ATOMS)
def summary_leaks(g: Graph) -> DataFrame:
    m = _machine(g)
    return kx.summary_leaks(m.deps, m.atoms, ["public"])


REVISION = """
SELECT 'source-trust' AS job, source AS target, CAST(count(*) AS VARCHAR) AS detail FROM atoms WHERE tx_from > 600 AND (pct < 60 OR taint IS NOT NULL) GROUP BY source
UNION ALL SELECT 'stale-belief', atom_id, belief FROM atoms WHERE belief IN ('Candidate', 'Disputed') AND 20000 - tx_from >= 15000
UNION ALL SELECT 'memory-consolidation', min(atom_id), CAST(count(*) AS VARCHAR) FROM atoms WHERE claim_type = 'AgentMemory' GROUP BY subject, object HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'dependency-invalidation', 'summary-' || subject, atom_id FROM atoms WHERE tx_from > 600 AND belief <> 'Accepted'"""


@query(REVISION, STATE, ATOMS)
def self_revision_jobs(g: Graph) -> DataFrame:
    """Trust, stale beliefs, repeated memories and what depends on claims that aren't accepted, as suggestions."""
    m = _machine(g)
    none = g.spark.createDataFrame([], "atom_ids array<string>, status string")
    return mt.source_trust(m.atoms, none, 600, 0.6).union(mt.stale_beliefs(m.atoms, 20000, 15000)).union(mt.repeated_memories(m.atoms)).union(mt.invalid_dependents(m.atoms, m.deps, 600))


@query("SELECT DISTINCT 'summary-invalidation' AS job, 'summary-' || subject AS target FROM atoms WHERE tx_from > 600 OR belief <> 'Accepted'", STATE, ATOMS)
def stale_summaries(g: Graph) -> DataFrame:
    m = _machine(g)
    summaries = m.atoms.select(F.concat(F.lit("summary-"), "subject").alias("atom_id")).distinct().select("atom_id", F.lit(0).cast("long").alias("tx_from"), F.lit("Accepted").alias("belief"), F.lit("Summary").alias("claim_type"))
    atoms = m.atoms.select("atom_id", "tx_from", "belief", "claim_type").union(summaries)
    return mt.stale_summaries(atoms, m.deps, g.spark.createDataFrame([], "atom_ids array<string>, status string"), 600).select("job", "target")


@query("SELECT 'entity-deduplication' AS job, subject AS target, least AS detail FROM (SELECT 'part-' || p_partkey AS subject, min('part-' || p_partkey) OVER (PARTITION BY p_size, regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '\\s+', ' ', 'g')) AS least FROM part) WHERE subject <> least")
def duplicate_names(g: Graph) -> DataFrame:
    parts = g.raw("part").select(F.col("p_size").alias("tenant"), F.lit("ENTITY_NAME").alias("predicate"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("object"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("subject"), F.lit(1).alias("tx_from"))
    return mt.duplicate_names(parts, 0)


@query("SELECT 'causal-refinement' AS job, CAST(cause AS VARCHAR) AS target, CAST(effect AS VARCHAR) AS detail FROM links WHERE pct < 60 OR mechanism = 'error'", LINKS)
def weak_causes(g: Graph) -> DataFrame:
    c = g.causal_links().select("cause", "effect", F.when(F.col("mechanism") != "error", F.col("mechanism")).alias("mechanism"), F.lit("note").alias("notes"), (F.col("pct") / 100).alias("confidence"))
    return mt.weak_causes(c, 0.6)


@query("SELECT DISTINCT root FROM members WHERE node IN (SELECT subject FROM located WHERE tx_from <= 2 UNION SELECT object FROM located WHERE tx_from <= 2)", LOCATED, REGIONS)
def invalidated_communities(g: Graph) -> DataFrame:
    return mt.invalidated_communities(_regions(g), g.located().filter("tx_from <= 2"))


@query("SELECT node, root FROM members", REGIONS)
def communities_after_change(g: Graph) -> DataFrame:
    """Components computed anew where nation 3 changed, kept elsewhere."""
    return gx.recompute_affected(g.located(), _regions(g), g.spark.createDataFrame([("nation-3",)], "id string"))


@query("SELECT node FROM members WHERE root = (SELECT root FROM members WHERE node = 'nation-3')", REGIONS)
def component_of_nation(g: Graph) -> DataFrame:
    return gx.component_of(g.located().select(F.col("subject").alias("a"), F.col("obj_entity").alias("b")), g.spark.createDataFrame([("nation-3",)], "id string"))


@query("SELECT 'customer-7>nation-' || c_nationkey || '>region-' || n_regionkey AS nodes, 2 AS length FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def shortest_path(g: Graph) -> DataFrame:
    end = g.raw("customer").filter("c_custkey = 7").join(g.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("r")).first()["r"]
    e = gx.edges(g.located()).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return gx.shortest_paths(e, g.spark.createDataFrame([("customer-7",)], "id string"), end, 4).select(F.array_join("nodes", ">").alias("nodes"), "length")


AROUND = """both_ways AS (SELECT id, subject AS a, object AS b FROM located UNION ALL SELECT id, object, subject FROM located),
one AS (SELECT b AS node, id AS hops FROM both_ways WHERE a = 'nation-3'),
two AS (SELECT e.b AS node, one.hops || '>' || e.id AS hops, e.id FROM one JOIN both_ways e ON e.a = one.node WHERE e.b <> 'nation-3' AND e.b <> one.node)"""


@query("SELECT node AS \"end\", hops, 1 AS length FROM one UNION ALL SELECT node, hops, 2 FROM two", LOCATED, AROUND)
def affected_paths(g: Graph) -> DataFrame:
    """Where a change of nation 3 leads within two steps, either way."""
    paths, _, _ = ag.evaluate(g.located(), g.spark.createDataFrame([("nation-3",)], "id string"), g.spark.createDataFrame([], "predicate string, delta double"), 2)
    return paths.select("end", F.array_join("hops", ">").alias("hops"), "length")


@query("SELECT id, 0.9::DOUBLE AS before, 0.7::DOUBLE AS after FROM (SELECT hops AS id FROM one UNION SELECT id FROM two)", LOCATED, AROUND)
def confidence_deltas(g: Graph) -> DataFrame:
    rules = g.spark.createDataFrame([("LOCATED_IN", -0.2), ("PLACED", 0.5)], "predicate string, delta double")
    return ag.evaluate(g.located(), g.spark.createDataFrame([("nation-3",)], "id string"), rules, 2)[2].select("id", "before", F.round("after", 6).alias("after"))


@query("SELECT node, depth FROM d WHERE depth > 0", LINKS, "d AS (SELECT effect AS node, 1 AS depth FROM links WHERE cause = 500 UNION SELECT l.effect, d.depth + 1 FROM d JOIN links l ON l.cause = d.node WHERE d.depth < 3)", recursive=True)
def disabled_link(g: Graph) -> DataFrame:
    """A user's events are a chain: without its first link nothing after it is reached."""
    links = g.causal_links()
    return ag.disable_link(links, 500, links.filter("cause = 500").first()["effect"], 3)


@query("SELECT event_id, kind, target FROM (SELECT event_id, 'event' AS kind, CAST(event_id AS VARCHAR) AS target FROM events UNION ALL SELECT event_id, 'entity', 'user-' || user_id FROM events WHERE user_id IS NOT NULL UNION ALL SELECT event_id, 'assertion', 'state-' || event_id FROM events)")
def hypothetical_events(g: Graph) -> DataFrame:
    e = g.raw("events").select("event_id", F.array_compact(F.array(F.concat(F.lit("user-"), F.col("user_id").cast("string")))).alias("entities"), F.array(F.concat(F.lit("state-"), F.col("event_id").cast("string"))).alias("assertions"))
    return ag.add_event(e)


# agents


@query("""SELECT 'act-' || e.event_id AS action_id, CAST((SELECT count(*) FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user' AND nxt IS NULL) AS BIGINT) AS memories,
  (l1.effect IS NOT NULL)::INT + (l2.effect IS NOT NULL)::INT AS effects, 1 AS missing, CASE WHEN e.event_id % 3 = 0 THEN (SELECT count(*) FROM state s WHERE s.subject = 'user-' || e.user_id AND s.context IS DISTINCT FROM 'tenant:1') ELSE 0 END AS violations
FROM events e LEFT JOIN links l1 ON l1.cause = e.event_id LEFT JOIN links l2 ON l2.cause = l1.effect WHERE e.user_id = 7""", STATE, LINKS)
def simulated_actions(g: Graph) -> DataFrame:
    """What bears on an action after each event of user 7."""
    a = g.raw("events").filter("user_id = 7").select(F.concat(F.lit("act-"), F.col("event_id").cast("string")).alias("action_id"), F.lit("user").alias("agent_id"), F.lit("user-7").alias("target"), "event_id", F.when(F.col("event_id") % 3 == 0, "High").otherwise("Low").alias("sensitivity"))
    needs = a.select("action_id", F.explode(F.array(F.lit("STATE"), F.lit("LOCATED_IN"))).alias("predicate"))
    out = ag.simulate(a, g.state(), g.memories(), g.causal_links(), g.state().filter("context = 'tenant:1'"), needs)
    return out.select("action_id", "memories", F.col("effects").cast("int").alias("effects"), F.col("missing").cast("int").alias("missing"), "violations")


@query("SELECT doc_id, CASE WHEN contains(t, 'verify') OR doc_id % 2 = 0 THEN 'verify_claim' WHEN contains(t, 'memory') THEN 'write_memory' ELSE 'verify_claim' END AS tool FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def chosen_tools(g: Graph) -> DataFrame:
    tools = F.array(F.lit("verify_claim"), F.lit("write_memory"))
    return g.raw("documents").select("doc_id", ag.choose_tool(F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 0, tools).alias("tool"))


@query("SELECT tool, max(urgency) AS urgency, count(*) AS gaps, max(risk) AS risk FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'crm' WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'purchase' THEN 'orders' END AS tool, event_id % 10 AS urgency, event_id % 4 AS risk FROM events) WHERE tool IS NOT NULL GROUP BY 1")
def recommended_tools(g: Graph) -> DataFrame:
    gaps = g.raw("events").select(F.col("event_id").alias("gap_id"), F.col("event_type").alias("predicate"), F.when(F.col("event_id") % 3 == 0, "crm").alias("suggested"), (F.col("event_id") % 10).alias("urgency"), (F.col("event_id") % 4).alias("risk"))
    tools = g.spark.createDataFrame([("crm", 3, ["refund"]), ("web", 1, ["click", "view"]), ("orders", 2, ["purchase", "click"])], "tool string, nth int, predicates array<string>")
    return ag.recommend_tools(gaps, tools)


@query("SELECT a.alias, a.canonical, b.alias AS member FROM (SELECT 'part-' || p_partkey AS alias, p_name AS canonical FROM part) a JOIN (SELECT 'part-' || p_partkey AS alias, p_name AS canonical FROM part) b ON a.canonical = b.canonical WHERE a.alias = 'part-7'")
def resolved_aliases(g: Graph) -> DataFrame:
    aliases = g.raw("part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("alias"), F.col("p_name").alias("canonical"))
    return ag.resolve_aliases(aliases, g.spark.createDataFrame([("part-7",)], "alias string"))


@query("SELECT id AS entry, min(id) OVER (PARTITION BY subject, context, tx_from // 1000) AS \"with\" FROM state", STATE)
def shared_answers(g: Graph) -> DataFrame:
    return ag.shared_answers(g.state().select(F.col("id").alias("entry"), F.col("subject").alias("key"), F.col("context").alias("tenant"), F.floor(F.col("tx_from") / 1000).alias("epoch")))


@query(f"SELECT DISTINCT subject AS key FROM state WHERE valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V})", STATE)
def cached_keys_valid(g: Graph) -> DataFrame:
    return ag.keys_valid_at(g.state().withColumnRenamed("subject", "key"), V)


@query("SELECT event_id, round((event_id % 2 = 0)::INT * 1.0 + (event_id % 3 = 0)::INT * 0.25 + (event_id % 5 = 0)::INT * 0.35 - (event_id % 7 = 0)::INT * 1.2 + (event_id % 11 = 0)::INT * 0.05 + (event_id % 13 = 0)::INT * 0.5, 4)::DOUBLE AS reward FROM events")
def action_rewards(g: Graph) -> DataFrame:
    m = lambda n: F.col("event_id") % n == 0
    return g.raw("events").select("event_id", F.round(ag.reward_for(m(2), m(7), m(3), m(5), m(11), m(13)), 4).alias("reward"))


@query("SELECT user_id AS episode, event_id AS step, event_id + 2 AS due FROM events WHERE event_type = 'purchase' AND event_id + 2 <= (SELECT max(event_id) FROM events e WHERE e.user_id = events.user_id)")
def delayed_consequences(g: Graph) -> DataFrame:
    return ag.consequences(g.raw("events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("step"), (F.col("event_type") == "purchase").alias("delayed")))


@query("SELECT 'mem-' || conv_id || '-' || turn AS answer_id, EXISTS (SELECT 1 FROM events WHERE event_id = turn AND event_id % 10 <> 0) AS verified FROM conversations")
def verified_answers(g: Graph) -> DataFrame:
    a = g.memories().select(F.col("id").alias("answer_id"), F.col("content").alias("text"), F.concat(F.lit("state-"), F.col("valid_from").cast("string")).alias("supporting_id"))
    return ag.verified_answers(a, g.state()).select("answer_id", "verified")


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (nxt IS NULL) AS active FROM (SELECT conv_id, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt FROM conversations UNION ALL SELECT conv_id, NULL FROM conversations WHERE turn = 0) GROUP BY 1")
def remembered(g: Graph) -> DataFrame:
    """Each conversation's first turn remembered once more."""
    m = g.memories()
    new = m.filter("valid_from = 0").select(F.concat("id", F.lit("-again")).alias("id"), "agent_id", "conv_id", "content", "valid_from", F.lit("source-0").alias("source_id"))
    return ag.remember(m, new).groupBy(F.col("conv_id").cast(g.raw("conversations").schema["conv_id"].dataType).alias("conv_id")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Active").alias("active"))


@query("SELECT subject, string_agg(line, chr(10) ORDER BY id) AS text FROM (SELECT id, subject, subject || ' STATE ' || obj_text || ' (' || pct || '%, ' || source || ')' AS line FROM state) GROUP BY subject", STATE)
def explained(g: Graph) -> DataFrame:
    return ag.explain(g.state(), g.entities())


@query(r"""SELECT claim_id, share_from, score FROM (SELECT 'mem-' || conv_id || '-' || turn AS claim_id, role AS share_from, round(len(list_intersect(['the', 'and', 'of'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / 3.0, 6)::DOUBLE AS score FROM conversations WHERE role = 'system') WHERE score > 0 ORDER BY score DESC, claim_id LIMIT 10""")
def recommended_sharing(g: Graph) -> DataFrame:
    r = g.memories().select(F.col("id").alias("claim_id"), F.col("agent_id").alias("created_by"), F.when(F.col("agent_id") == "system", "Public").otherwise("Private").alias("visibility"), F.array().cast("array<string>").alias("shared_with"), F.col("content").alias("text"))
    return sh.recommend_sharing(r, g.spark.createDataFrame([], "team string, agent string"), "user", ["assistant", "system"], "the and of")


@query("SELECT event_id AS id, CASE WHEN user_id = 7 THEN true WHEN event_type = 'purchase' THEN event_id % 2 = 0 WHEN event_type = 'error' THEN user_id % 3 = 1 WHEN event_type = 'click' THEN true ELSE false END AS allowed FROM events WHERE user_id IS NOT NULL")
def exchange_policy(g: Graph) -> DataFrame:
    e = g.raw("events").filter("user_id is not null")
    kind = F.when(F.col("event_type") == "purchase", "Private").when(F.col("event_type") == "error", "Team").when(F.col("event_type") == "click", "Public").otherwise("Secret")
    named = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("7"))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("id"), pk.allows_exchange(F.col("user_id").cast("string"), F.lit("7"), kind, named, F.col("user_id") % 3 == 1).alias("allowed"))


@query("SELECT claim_id FROM (SELECT id AS claim_id, row_number() OVER (PARTITION BY obj_text ORDER BY pct DESC, tx_from DESC, id) AS r FROM state WHERE context IS NULL) WHERE r = 1", STATE)
def accepted_facts(g: Graph) -> DataFrame:
    r = g.state().select(F.col("id").alias("claim_id"), F.col("obj_text").alias("text"), "confidence", "tx_from", F.when(F.col("context").isNull(), "Public").otherwise("Private").alias("visibility"))
    return sh.accepted(r).select("claim_id")


# trust and judging


@query("SELECT id, coalesce(t.trust_pct, 50)::DOUBLE AS trust_pct FROM state s LEFT JOIN (SELECT id AS sid, trust_pct FROM sources) t ON t.sid = s.source", STATE, SOURCES)
def average_trust(g: Graph) -> DataFrame:
    return bx.average_trust(g.state(), g.sources(), 50).select("id", "trust_pct")


@query("SELECT id, CASE WHEN trust_pct >= 80 THEN 'Trusted' WHEN trust_pct >= 50 THEN 'Mixed' WHEN trust_pct IS NOT NULL THEN 'Untrusted' ELSE 'Unknown' END AS band FROM sources", SOURCES)
def trust_bands(g: Graph) -> DataFrame:
    return g.sources().select("id", bx.trust_band(F.col("trust_score")).alias("band"))


@query("""SELECT source_id, round(list_reduce(list_prepend(0, list(CAST(r AS INTEGER) ORDER BY seq)), lambda a, x: greatest(-5, least(5, a + x))) * 0.05, 6)::DOUBLE AS delta
FROM (SELECT 'user-' || user_id AS source_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS r FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY source_id""")
def human_ratings(g: Graph) -> DataFrame:
    e = g.raw("events").filter("event_type in ('purchase', 'error')")
    return bx.human_delta(e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("rating"))).select("source_id", F.round("delta", 6).alias("delta"))


JUDGED = f"""cases AS (SELECT subject, list(id) FILTER (obj_text = 'purchase') AS want, list(id) FILTER (obj_text IN ('purchase', 'error') AND tx_from % 2 = 0) AS cited,
  list(id) FILTER (tx_from % 3 <> 0) AS seen, list(id) FILTER (tx_from % 3 <> 0 AND obj_text = 'purchase') AS relevant,
  list(id) FILTER (tx_from % 3 <> 0 AND obj_text = 'purchase' AND valid_from <= {V} AND (valid_to IS NULL OR {V} < valid_to)) AS fresh, list(id) FILTER (tx_from % 10 = 0) AS unsafe, count(*) AS n FROM state GROUP BY subject)"""


@query("""SELECT subject, round(least(1, 0.7 + 0.3 * coalesce(len(list_intersect(want, cited)), 0) / nullif(len(want), 0)::DOUBLE), 6)::DOUBLE AS correctness,
  round(CASE WHEN coalesce(len(relevant), 0) = 0 THEN 0 ELSE coalesce(len(fresh), 0) / len(relevant)::DOUBLE END, 6)::DOUBLE AS temporal,
  round(0.45 + 0.45 * coalesce(len(list_intersect(want, seen)), 0) / len(want)::DOUBLE + 0.1, 6)::DOUBLE AS missing_context,
  round(1 - coalesce(len(list_intersect(cited, unsafe)), 0) / nullif(len(cited), 0)::DOUBLE, 6)::DOUBLE AS unsafe_memory, CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS contradictions
FROM cases WHERE want IS NOT NULL AND cited IS NOT NULL""", STATE, JUDGED)
def judged_answers(g: Graph) -> DataFrame:
    """Answers about each user's purchases, judged against all of its events."""
    s, c = g.state(), F.col("tx_from")
    ids = lambda cond: F.collect_list(F.when(cond, F.col("id")))
    none = F.array().cast("array<string>")
    item = F.struct(F.lit(None).cast("string").alias("source"), F.col("id").alias("assertion"), F.lit(None).cast("string").alias("memory"), "valid_from", "valid_to", F.col("tx_from").alias("known_from"))
    cases = s.groupBy("subject").agg(ids(F.col("obj_text") == "purchase").alias("want_assertions"), ids(F.col("obj_text").isin("purchase", "error") & (c % 2 == 0)).alias("cited_assertions"), F.collect_list(F.when(c % 3 != 0, item)).alias("context"), ids(c % 10 == 0).alias("unsafe_memories"), F.count("*").alias("n"))
    cases = cases.filter("size(want_assertions) > 0 and size(cited_assertions) > 0").withColumns({
        "answer": F.concat(F.col("subject"), F.lit(" made a purchase")), "answer_terms": F.array(F.lit("Purchase")), "forbidden_terms": none, "expected_unknown": F.lit(False), "stated_unknown": F.lit(False), "want_sources": none, "want_memories": none, "cited_sources": none, "trace_sources": none,
        "valid_at": F.lit(V), "known_at": F.lit(None).cast("long"), "used_memories": F.col("cited_assertions"), "expected_conflicts": (F.col("n") % 2).cast("int"), "contradicted_context": F.lit(0),
    })
    out = jx.judged(cases)
    return out.select("subject", *[F.round(n, 6).alias(n) for n in ("correctness", "temporal", "missing_context", "unsafe_memory", "contradictions")])


DEFENDED = """CASE WHEN doc_id % 5 = 0 THEN 'tenant_denied' WHEN doc_id % 7 = 0 THEN 'flagged_conflict' WHEN doc_id % 11 = 0 THEN 'temporal_rejected' WHEN coalesce(trust_pct, 50) < 70 AND doc_id % 3 = 0 THEN 'trust_downgraded' WHEN doc_id % 13 = 0 THEN 'quarantined' ELSE 'accepted' END"""


@query(f"SELECT decision, count(*) AS n FROM (SELECT {DEFENDED} AS decision FROM (SELECT observed_at AS doc_id, trust_pct FROM sources)) GROUP BY 1", SOURCES)
def defences(g: Graph) -> DataFrame:
    """Scenarios made of all documents, against the defence."""
    i = F.col("observed_at")
    attack = F.when(i % 7 == 0, "conflicting_entity_identity").when(i % 13 == 0, "poisoned_document_ingestion").otherwise("none")
    t = g.sources().select(i.alias("id"), F.lit("plain").alias("dataset"), attack.alias("attack"), F.lit("a").alias("tenant"), F.when(i % 5 == 0, "b").otherwise("a").alias("actual_tenant"), (F.coalesce("trust_pct", F.lit(50)) / 100).alias("source_trust"), F.when(i % 3 == 0, "The CEO signed it").otherwise("nobody").alias("claimed_authority"), F.when(i % 11 == 0, 2020).otherwise(2026).alias("valid_at"), F.lit("plain").alias("payload"))
    return jx.defended(t).groupBy("decision").agg(F.count("*").alias("n"))


@query(f"SELECT round(avg((d = 'accepted' AND coalesce(trust_pct, 50) < 70 AND doc_id % 3 = 0)::INT), 6) AS false_trust, round(avg((d <> 'accepted')::INT), 6) AS safe_refusal FROM (SELECT *, {DEFENDED} AS d FROM (SELECT observed_at AS doc_id, trust_pct FROM sources))", SOURCES)
def defence_rates(g: Graph) -> DataFrame:
    i = F.col("observed_at")
    attack = F.when(i % 7 == 0, "conflicting_entity_identity").when(i % 13 == 0, "poisoned_document_ingestion").otherwise("none")
    t = g.sources().select(F.lit("plain").alias("dataset"), attack.alias("attack"), F.lit("a").alias("tenant"), F.when(i % 5 == 0, "b").otherwise("a").alias("actual_tenant"), (F.coalesce("trust_pct", F.lit(50)) / 100).alias("source_trust"), F.when(i % 3 == 0, "The CEO signed it").otherwise("nobody").alias("claimed_authority"), F.when(i % 11 == 0, 2020).otherwise(2026).alias("valid_at"), F.lit("plain").alias("payload"))
    return jx.defence_rates(jx.defended(t)).select(F.round("false_trust", 6).alias("false_trust"), F.round("safe_refusal", 6).alias("safe_refusal"))


@query("""SELECT user_id AS decision, round(least(1, greatest(0, 0.5 + sum(CASE event_type WHEN 'click' THEN 0.35 WHEN 'error' THEN -0.35 ELSE 0 END) + sum(CASE WHEN event_type = 'purchase' THEN 0.35 ELSE -0.25 END + CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 0 END))), 6)::DOUBLE AS label FROM events GROUP BY 1""")
def outcome_labels(g: Graph) -> DataFrame:
    e = g.raw("events").withColumnRenamed("user_id", "decision")
    f = e.select("decision", F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "error", "rejection").otherwise("view").alias("kind"))
    o = e.select("decision", (F.col("event_type") == "purchase").alias("success"), (F.col("event_id") % 2 == 0).alias("accepted"))
    return jx.outcome_label(f, o).select("decision", F.round("label", 6).alias("label"))


@query("SELECT round(avg(1 - abs(label - s)), 6) AS mean_reward, round(avg(abs(label - s)), 6) AS mean_error, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS corrections, count(*) AS examples FROM (SELECT event_type, (event_id % 11) / 10.0 AS label, least(1, greatest(0, 0.1 + 0.05 * (event_id % 7) + 0.2 * (event_id % 3)))::DOUBLE AS s FROM events)")
def policy_report(g: Graph) -> DataFrame:
    i = F.col("event_id").cast("double")
    e = g.raw("events").select(((F.col("event_id") % 11) / 10).alias("label"), F.when(F.col("event_type") == "error", "correction").otherwise(F.col("event_type")).alias("kind"), F.create_map(F.lit("a"), i % 7, F.lit("b"), i % 3).alias("x"))
    return ax.policy_report(e, ax.linear_score(F.col("x"), {"a": 0.05, "b": 0.2, "c": 9.0}, 0.1)).select(F.round("mean_reward", 6).alias("mean_reward"), F.round("mean_error", 6).alias("mean_error"), "clicks", "corrections", "examples")


@query("SELECT event_type AS task, round(avg((event_id % 2 = event_id % 3)::INT), 6) AS accuracy FROM events GROUP BY 1")
def accuracy_by_task(g: Graph) -> DataFrame:
    p = g.raw("events").select(F.col("event_type").alias("task"), (F.col("event_id") % 2).alias("label"), (F.col("event_id") % 3).alias("predicted"))
    return ax.accuracy_by_task(p, g.spark.createDataFrame([("click", 0.5)], "task string, baseline double")).select("task", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT baseline, count(*) AS wins FROM (SELECT family, arg_max(baseline, s || '|' || baseline) AS baseline FROM (SELECT user_id AS family, event_type AS baseline, lpad(CAST(count(*) AS VARCHAR), 9, '0') AS s FROM events GROUP BY ALL) GROUP BY family) GROUP BY 1")
def family_wins(g: Graph) -> DataFrame:
    return ax.family_wins(g.raw("events").groupBy(F.col("user_id").alias("family"), F.col("event_type").alias("baseline")).agg(F.count("*").alias("score")))


@query("SELECT cluster, name, type FROM (SELECT event_type AS cluster, k AS name, 'text' AS type, count(DISTINCT event_id) AS n FROM (SELECT event_type, event_id, unnest(CASE WHEN user_id % 2 = 0 THEN ['id', 'value'] ELSE ['id', 'other'] END) AS k FROM events) GROUP BY ALL) t WHERE n = (SELECT count(DISTINCT event_id) FROM events WHERE event_type = cluster)")
def common_properties(g: Graph) -> DataFrame:
    p = g.raw("events").select(F.col("event_type").alias("cluster"), F.col("event_id").alias("id"), F.explode(F.when(F.col("user_id") % 2 == 0, F.array(F.lit("id"), F.lit("value"))).otherwise(F.array(F.lit("id"), F.lit("other")))).alias("name"), F.lit("text").alias("type"))
    return ax.common_properties(p)


# context


@query("SELECT unit_id, round(tx_from / (SELECT max(tx_from) FROM state)::DOUBLE, 6)::DOUBLE AS recency, round(coalesce(trust_pct, 50) / 100.0, 6)::DOUBLE AS source_trust, 0.25::DOUBLE AS centrality, CASE WHEN obj_text IN ('click', 'purchase') THEN 0.5 ELSE 0 END::DOUBLE AS relevance, CAST(CASE WHEN tx_from % 2 = 0 THEN 3.1 ELSE 0.1 END AS DOUBLE) AS extra FROM (SELECT s.id AS unit_id, s.tx_from, s.obj_text, t.trust_pct FROM state s LEFT JOIN sources t ON t.id = s.source)", STATE, SOURCES)
def scored_units(g: Graph) -> DataFrame:
    """Each event as a unit of context for a task about clicks and purchases."""
    none = F.array().cast("array<string>")
    u = g.state().select(F.col("id").alias("unit_id"), F.col("obj_text").alias("text"), F.lit(2).alias("level"), (F.col("tx_from") % 2 == 0).alias("required"), F.array("id").alias("assertion_ids"), "source_ids", none.alias("contradiction_ids"), none.alias("entity_ids"))
    t = ct.score_units(u, g.state(), g.sources(), "click purchase")
    extra = F.col("score") - F.col("recency") - F.col("confidence") - F.col("source_trust") - F.col("centrality") - F.col("relevance")
    return t.select("unit_id", F.round("recency", 6).alias("recency"), F.round("source_trust", 6).alias("source_trust"), "centrality", "relevance", F.round(extra, 6).alias("extra"))


@query("SELECT atom_id, CAST(4 * (subject IN ('user-9', 'user-1'))::INT + 3 + 4 * (object = 'click')::INT + 5 * (claim_type = 'AgentMemory' AND subject = 'user-9')::INT + 2 * (belief = 'Disputed')::INT AS INTEGER) AS relevance FROM atoms WHERE subject IN ('user-9', 'user-1', 'user-2')", STATE, ATOMS)
def model_relevance(g: Graph) -> DataFrame:
    atoms = _machine(g).atoms.filter("subject in ('user-9', 'user-1', 'user-2')")
    return atoms.select("atom_id", ct.model_relevance("What state of user-9 and user-1: CLICK?", "user-9").cast("int").alias("relevance"))


@query("SELECT id FROM state ORDER BY pct DESC, tx_from DESC, id LIMIT 4", STATE)
def task_unit(g: Graph) -> DataFrame:
    return ct.top_assertions(g.state()).select("id")


@query("SELECT 1.0::DOUBLE AS coverage, count(*) AS n FROM state", STATE)
def citation_coverage(g: Graph) -> DataFrame:
    return ct.citation_coverage(g.state()).crossJoin(g.state().agg(F.count("*").alias("n")))


@query("""SELECT id, round((0.45 * hits / 3.0 + 0.35 * (CASE WHEN turn % 2 = 0 THEN 0.5 ELSE 0 END) + CASE WHEN role = 'system' THEN 0.35 WHEN role = 'user' THEN 0.2 ELSE 0.1 END + 0.2 * 0.9) * CASE WHEN nxt IS NULL THEN 1.0 ELSE 0.15 END, 6)::DOUBLE AS score FROM (
  SELECT 'mem-' || conv_id || '-' || turn AS id, role, turn, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt, len(list_intersect(['the', 'and', 'of'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS hits FROM conversations)""")
def graph_temporal_memories(g: Graph) -> DataFrame:
    kind = F.when(F.col("agent_id") == "system", "Correction").when(F.col("agent_id") == "user", "Semantic").otherwise("Episodic")
    m = g.memories().withColumns({"kind": kind, "confidence": F.lit(0.9), "entities": F.when(F.col("valid_from") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))})
    return m.select("id", F.round(ct.graph_temporal_score(F.lit("the and of"), F.array(F.lit("a"), F.lit("b"))), 6).alias("score"))


@query("""SELECT conv_id, id, tokens FROM fold WHERE taken""", """turns AS (SELECT conv_id, 'mem-' || conv_id || '-' || turn AS id, greatest(1, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, id) AS r FROM (SELECT *, '' AS id FROM conversations)),
fold AS (SELECT conv_id, id, tokens, r, tokens <= 64 AS taken, 64 - CASE WHEN tokens <= 64 THEN tokens ELSE 0 END AS room FROM turns WHERE r = 1
  UNION ALL SELECT t.conv_id, t.id, t.tokens, t.r, t.tokens <= f.room, f.room - CASE WHEN t.tokens <= f.room THEN t.tokens ELSE 0 END FROM fold f JOIN turns t ON t.conv_id = f.conv_id AND t.r = f.r + 1)""", recursive=True)
def packed_turns(g: Graph) -> DataFrame:
    """Turns of each conversation packed into 64 tokens, latest first, skipping those that don't fit."""
    m = g.memories().withColumn("conv_id", F.col("conv_id").cast(g.raw("conversations").schema["conv_id"].dataType))
    return pk.pack_texts(m, 64, ["conv_id"], [F.desc("valid_from"), F.col("id")])


CHOSEN = """picked AS (SELECT id FROM state WHERE subject = 'user-9' AND context IS NULL ORDER BY id LIMIT 6),
pack AS (SELECT id FROM picked UNION SELECT assertion_a FROM conflicts WHERE assertion_a IN (SELECT id FROM picked) OR assertion_b IN (SELECT id FROM picked) UNION SELECT assertion_b FROM conflicts WHERE assertion_a IN (SELECT id FROM picked) OR assertion_b IN (SELECT id FROM picked))"""


@query("SELECT id FROM pack ORDER BY id LIMIT 6", STATE, CONFLICTS, CHOSEN)
def compiled_pack(g: Graph) -> DataFrame:
    """Evidence for a plain question about one user."""
    own = g.state().filter("subject = 'user-9'")  # a contradiction has one subject
    return rx.compile_pack(rx.Request("What state is user-9 in?"), own, g.entities(), g.sources()).assertions.select("id")


@query("SELECT id FROM entities WHERE id = 'user-9' OR regexp_replace(lower(canonical_name), '[-_]', ' ', 'g') = 'france'", ENTITIES)
def mentioned_entities(g: Graph) -> DataFrame:
    return rx.mentioned(g.entities().filter("canonical_name is null or lower(canonical_name) != ''"), "Did user-9 buy in France").filter("id = 'user-9' or not startswith(id, 'user-')")


# the graph: indexes, language, closures


@query(f"SELECT {SHOWN} FROM state WHERE obj_text = 'error' AND context IS NULL AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) ORDER BY id LIMIT 1000", STATE)
def by_object_and_context(g: Graph) -> DataFrame:
    return sx.find(g.state(), sx.GraphQuery(predicate="STATE", obj_text="error", any_context=False, valid_at=V, limit=1000)).select(*_SHOWN)


@query("SELECT id FROM located WHERE object = 'nation-3' ORDER BY id LIMIT 1000", LOCATED)
def by_object_entity(g: Graph) -> DataFrame:
    return sx.find(g.located(), sx.GraphQuery(predicate="LOCATED_IN", obj_entity="nation-3", limit=1000)).select("id")


@query(f"SELECT id, valid_to < {V} AS was_until, valid_to = {V} AS became FROM state WHERE valid_to IS NOT NULL", STATE)
def ended_relations(g: Graph) -> DataFrame:
    """Which states held until before a moment, and which became false at it."""
    at = F.lit(V)
    return g.state().filter("valid_to is not null").select("id", tm.before("valid_from", "valid_to", at, at).alias("was_until"), tm.meets("valid_from", "valid_to", at, at).alias("became"))


@query("SELECT 'customer-7' AS start, 'region-' || n_regionkey AS \"end\", 2 AS length FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7 UNION ALL SELECT 'customer-7', 'nation-' || c_nationkey, 1 FROM customer WHERE c_custkey = 7")
def lang_path(g: Graph) -> DataFrame:
    engine = lang.Engine(g.located(), g.entities(), g.causal_links())
    ends = g.raw("customer").filter("c_custkey = 7").join(g.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", "n_regionkey").first()
    path = lambda end: engine.run(f'PATH FROM Id("customer-7") TO Id("{end}") MAX_DEPTH 3').select("start", "end", "length")
    return path(f"region-{ends['n_regionkey']}").union(path(f"nation-{ends['c_nationkey']}"))


@query("""SELECT start, length, confidence FROM w WHERE confidence >= 0.5""", LINKS, """w AS (SELECT cause AS start, 1 AS length, round(pct / 100.0, 2)::DOUBLE AS confidence, pct AS p FROM links WHERE effect = 900
  UNION ALL SELECT l.cause, w.length + 1, round(w.p * l.pct / power(100, w.length + 1), 2)::DOUBLE, w.p * l.pct FROM w JOIN links l ON l.effect = w.start WHERE w.length < 2)""", recursive=True)
def lang_causes(g: Graph) -> DataFrame:
    return lang.Engine(g.state(), g.entities(), g.causal_links()).run('CAUSES OF Event("900") MAX_DEPTH 2 MIN_CONFIDENCE 0.5').select("start", "length", "confidence")


@query("SELECT assertion_a, assertion_b FROM conflicts WHERE assertion_a IN (SELECT id FROM state WHERE subject = 'user-9')", STATE, CONFLICTS)
def lang_contradictions(g: Graph) -> DataFrame:
    return lang.Engine(g.state(), g.entities(), g.causal_links()).run('CONTRADICTIONS FOR Id("user-9")').select("assertion_a", "assertion_b")


@query("SELECT 'region-' || r_regionkey AS id FROM region WHERE r_name = 'ASIA'")
def lang_resolved(g: Graph) -> DataFrame:
    found = lang.Engine(g.state(), g.entities(), g.causal_links()).resolve(lang.Selector(**{"kind": "named", "name": "asia", "type": "Place"}))
    return g.spark.createDataFrame([(found,)], "id string")


def _activation(rounds: int) -> str:
    """The ranking unrolled: one common table a round."""
    steps = [f"r{k + 1} AS (SELECT n.node, 0.15 * n.base + 0.85 * coalesce(x.g, 0) AS score FROM nodes n LEFT JOIN (SELECT e.b AS node, sum(r.score / m.n) AS g FROM r{k} r JOIN nodes m ON m.node = r.node JOIN e ON e.a = r.node GROUP BY e.b) x ON x.node = n.node)" for k in range(rounds)]
    return ",\n".join(steps)


@query(f"SELECT node, round(score, 6) AS score FROM r{ac.ROUNDS} ORDER BY 2 DESC, 1 LIMIT 10", LOCATED, f"""pairs AS (SELECT id AS a, subject AS b FROM located UNION SELECT id, object FROM located UNION SELECT id, 'source-' || (tx_from % (SELECT count(*) FROM documents)) FROM located),
e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
nodes AS (SELECT a AS node, count(*) AS n, CASE WHEN a = 'nation-3' THEN 1.0 ELSE 0.0 END::DOUBLE AS base FROM e GROUP BY a),
r0 AS (SELECT node, CASE WHEN base > 0 THEN base ELSE 1.0 / (SELECT count(*) FROM nodes) END AS score FROM nodes)""", _activation(ac.ROUNDS))
def activation_ranks(g: Graph) -> DataFrame:
    """The ten strongest after a thought of nation 3."""
    seeds = g.spark.createDataFrame([("nation-3", 1.0)], "id string, weight double")
    return ac.rank(ac.adjacency(g.located()), seeds).select("node", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node").limit(10)


@query("""SELECT id, predicted FROM (SELECT v.id, c.label AS predicted, row_number() OVER (PARTITION BY v.id ORDER BY round(sum((v.x - c.mean) ** 2), 6), c.label) AS r FROM v JOIN c ON c.pos = v.pos GROUP BY v.id, c.label) WHERE r = 1""",
"""v AS (SELECT 'vec-' || vec_id AS id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, pos, avg(x) AS mean FROM v GROUP BY label, pos)""")
def nearest_centroids(g: Graph) -> DataFrame:
    """The label whose mean embedding is nearest, for every vector."""
    v = g.vectors().filter("label is not null")
    return ax.nearest_centroid(v, "id", "embedding", ax.centroids(v, "label", "embedding"), "label")


@query("SELECT predicate, support, 0.85::DOUBLE AS confidence FROM (SELECT 'LOCATED_IN' AS predicate, count(*) AS support FROM located UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM supplied) WHERE predicate = 'never'", LOCATED, SUPPLIED)
def learned_constraints(g: Graph) -> DataFrame:
    """Predicates whose subjects repeat but hold one object at a time: places don't repeat, parts have several suppliers."""
    return ax.cardinality_candidates(g.located().union(g.supplied()))


@query("SELECT role AS agent_id, count(*) AS n, min(id) AS first FROM (SELECT role, 'mem-' || conv_id || '-' || turn AS id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM conversations) GROUP BY role, k HAVING count(*) >= 2")
def consolidated_memories(g: Graph) -> DataFrame:
    return mx.consolidate(g.memories()).select("agent_id", "n", "first")


# the log


@query("SELECT event_id AS seq FROM events WHERE event_id < 700 AND event_id % 2 = 0")
def appended_once(g: Graph) -> DataFrame:
    """Of commands whose keys repeat in the log only new ones are appended."""
    log = g.events_log().select("seq", F.concat(F.lit("k"), (F.col("seq")).cast("string")).alias("idempotency_key"), F.col("kind").alias("fingerprint"))
    return ev.idempotent(log.filter("seq < 700"), log.filter("seq % 2 = 1"))[0].select("seq")


@query("SELECT event_id AS seq FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_type = 'error' AND event_id > 50)")
def recovered_log(g: Graph) -> DataFrame:
    """The log up to its first bad record: the first error after 50."""
    return ev.recover(g.events_log().select("seq", ((F.col("kind") != "error") | (F.col("seq") <= 50)).alias("ok"))).select("seq")


@query("SELECT id, CASE WHEN tx_from % 3 = 0 THEN 'Retracted' ELSE status END AS status, CASE WHEN tx_from % 3 = 0 THEN tx_from + 7 ELSE tx_to END AS tx_to FROM state", STATE)
def retractions_applied(g: Graph) -> DataFrame:
    s = g.state()
    return ev.apply_retractions(s, s.filter("tx_from % 3 = 0").select("id", (F.col("tx_from") + 7).alias("tx"))).select("id", "status", "tx_to")


@query("SELECT id, CASE WHEN tx_from % 5 = 0 THEN 0.25 ELSE pct / 100.0 END::DOUBLE AS confidence, CASE WHEN tx_from % 5 = 0 AND source <> 'source-1' THEN 2 ELSE 1 END AS sources FROM state", STATE)
def confidence_applied(g: Graph) -> DataFrame:
    s = g.state()
    u = s.filter("tx_from % 5 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.array(F.lit("source-1")).alias("source_ids")).withColumn("confidence", F.when(F.col("seq") == 2, 0.25).otherwise(0.75))
    return ev.apply_confidence(s, u).select("id", "confidence", F.size("source_ids").alias("sources"))


# text and ingestion


@query(r"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:5], ' ') END AS short,
  nullif(regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS day, md5(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g'))) AS name FROM documents""")
def text_functions(g: Graph) -> DataFrame:
    t = F.col("text")
    return g.raw("documents").select("doc_id", fx.truncate_to_tokens(t, 5).alias("short"), fx.first_iso_date(t).alias("day"), F.md5(fx.normalize_name(t)).alias("name"))


@query("SELECT page_id, CASE WHEN position('<title>' IN lower(html)) > 0 AND position('</title>' IN lower(html)) > 0 THEN substr(html, position('<title>' IN lower(html)) + 7, position('</title>' IN lower(html)) - position('<title>' IN lower(html)) - 7) END AS title FROM pages")
def text_between(g: Graph) -> DataFrame:
    return g.raw("pages").select("page_id", fx.extract_between(F.col("html"), "<title>", "</title>").alias("title"))


@query("SELECT event_id, CAST(event_id AS BIGINT) AS amount, event_type AS unit, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day FROM events")
def parsed_literals(g: Graph) -> DataFrame:
    amount, unit = fx.parse_duration(F.concat(F.col("event_id").cast("string"), F.col("event_type")))
    return g.raw("events").select("event_id", amount.alias("amount"), unit.alias("unit"), fx.parse_timestamp(F.date_format("ts", "yyyy-MM-dd")).alias("day"))


@query("""SELECT event_id, round((list_sum(list_transform(list_filter(b, lambda x, i: (i - 1) % 4 = 0), lambda x: x::DOUBLE)) / 255 / len(b)), 6)::DOUBLE AS first, CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END::DOUBLE AS third FROM (SELECT event_id, list_transform(string_split(event_type, ''), lambda c: ascii(c)) AS b FROM events)""")
def simple_embeddings(g: Graph) -> DataFrame:
    return g.raw("events").select("event_id", F.round(fx.byte_embedding(F.col("event_type"))[0], 6).alias("first"), fx.one_hot(F.col("event_id"))[2].alias("third"))


@query(r"""SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, 'memory_id=')) >= 3 OR regexp_matches(text, '(?i)\b(api[_-]?key|secret|password|token)\s*[=:]\s*\S+') OR regexp_matches(text, '\bsk-[A-Za-z0-9]{16,}\b') OR regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b')""")
def exfiltration_scan(g: Graph) -> DataFrame:
    return g.raw("documents").filter(fx.exfiltration(F.col("text"), ig.has_secret(F.col("text")))).select("doc_id")


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def encrypted_round_trip(g: Graph) -> DataFrame:
    """Texts encrypted, moved to a new key and decrypted."""
    old, new = "00" * 16, "0f" * 16
    t = ig.encrypt(g.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", old)
    return ig.decrypt(ig.rotate_key(t, "text", old, new), "text", new).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT event_id, strlen(event_type) || ':' || event_type || strlen(CAST(user_id AS VARCHAR)) || ':' || user_id AS record FROM events WHERE user_id IS NOT NULL")
def encoded_records(g: Graph) -> DataFrame:
    return g.raw("events").filter("user_id is not null").select("event_id", ig.encode_parts(F.array("event_type", F.col("user_id").cast("string"))).alias("record"))


_LINES = "lines AS (SELECT event_id, 'candidate: user-' || user_id || ' | did | ' || event_type || ' | valid=' || event_id || '..' || ' | confidence=0.5 | evidence=log' AS content FROM events WHERE user_id IS NOT NULL)"


def _candidate_docs(g: Graph) -> DataFrame:
    e = g.raw("events").filter("user_id is not null")
    line = F.concat(F.lit("candidate: user-"), F.col("user_id").cast("string"), F.lit(" | did | "), "event_type", F.lit(" | valid="), F.col("event_id").cast("string"), F.lit(".. | confidence=0.5 | evidence=log"))
    return e.select("event_id", F.concat(F.lit("A note\n\n"), line, F.lit("\nentity: a=1 | b = 2\n")).alias("text"))


@query("SELECT event_id AS id, 'user-' || user_id AS subject_text, event_type AS object_text, CAST(event_id AS BIGINT) AS valid_from, CAST(NULL AS BIGINT) AS valid_to, 0.5::DOUBLE AS confidence, 'log' AS evidence_text FROM events WHERE user_id IS NOT NULL")
def extracted_candidates(g: Graph) -> DataFrame:
    return ig.candidates(ig.line_chunks(_candidate_docs(g), "event_id", "text")).select("id", "subject_text", "object_text", "valid_from", "valid_to", "confidence", "evidence_text")


@query("SELECT frame, n FROM (SELECT 'sources' AS frame, count(*) AS n FROM lines UNION ALL SELECT 'evidence', 3 * count(*) FROM lines UNION ALL SELECT 'directives', count(*) FROM lines UNION ALL SELECT 'candidates', count(*) FROM lines UNION ALL SELECT 'embeddings', 4 * count(*) FROM lines UNION ALL SELECT 'tasks', 2 * count(*) FROM lines)", _LINES)
def ingested_batch(g: Graph) -> DataFrame:
    """The six frames of one ingested batch, by their number of rows."""
    frames = ig.ingest(_candidate_docs(g), "event_id", "text", "note")
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT id, 'user-' || user_id AS subject, event_type AS object FROM (SELECT event_id AS id, user_id, event_type FROM events WHERE user_id IS NOT NULL)")
def csv_claims(g: Graph) -> DataFrame:
    e = g.raw("events").filter("user_id is not null")
    text = F.concat(F.lit("subject,predicate,object,evidence\nuser-"), F.col("user_id").cast("string"), F.lit(",did , "), "event_type", F.lit(",log\n,,,\n"))
    return ig.csv_rows(ig.line_chunks(e.select("event_id", text.alias("text")), "event_id", "text")).select("id", "subject", "object")


@query("SELECT event_id, event_type AS entity FROM events")
def json_entities(g: Graph) -> DataFrame:
    t = g.raw("events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("entity"), F.lit("Kind").alias("type"))).alias("text"))
    return ig.json_entity(t, "event_id", "text").select("event_id", "entity")


@query("SELECT 'state-' || event_id AS id, 0 AS hop, 'user-' || user_id AS node FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'state-' || event_id, 1, event_type FROM events WHERE user_id IS NOT NULL")
def path_examples(g: Graph) -> DataFrame:
    s = g.state().filter("subject is not null")
    return xp.path_supervision(s.select("id", F.lit("What?").alias("question"), F.col("obj_text").alias("answer"), F.array("id").alias("evidence"), F.array("subject", "obj_text").alias("path"))).select("id", "hop", "node")


@query("""SELECT 'state-' || event_id AS id, event_type AS chosen, 'nothing' AS rejected FROM events WHERE event_id % 2 = 0""")
def preference_pairs(g: Graph) -> DataFrame:
    e = g.state().select("id", F.lit("What?").alias("question"), F.col("obj_text").alias("answer"), F.when(F.col("tx_from") % 2 == 0, "nothing").alias("rejected"), F.array("id").alias("evidence"), F.array("subject").alias("path"))
    v = xp.preferences(e)
    at = lambda p: F.get_json_object("value", p)
    return v.select(at("$.id").alias("id"), at("$.chosen[0].content").alias("chosen"), at("$.rejected[0].content").alias("rejected"))
