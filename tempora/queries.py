"""The registered queries over the evidence graph, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.functions import temporal as tm
from tempora.operators import activation as ac
from tempora.operators import aggregates as ax
from tempora.operators import belief as bx
from tempora.operators import contradictions as cx
from tempora.operators import evaluate as el
from tempora.operators import events as ev
from tempora.operators import evidence as pk
from tempora.operators import graph as gx
from tempora.operators import kernel as kx
from tempora.operators import maintenance as mt
from tempora.operators import memory as mx
from tempora.operators import ontology as on
from tempora.operators import select as sx
from tempora.operators import sharing as sh
from tempora.plans import lang
from tempora.sources import ingest as ig
from tempora.sources.graph import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

V, K, DAY = 1705000000, 600, 86400  # a moment of valid time in seconds, one of transaction time, a day
START, END = 1704067200, 1706659200

NDOCS = "(SELECT count(*) FROM documents)"
STATE = f"""state AS (
  SELECT 'state-' || event_id AS id, 'user-' || user_id AS subject, 'STATE' AS predicate, event_type AS obj_text,
         CAST(floor(epoch(ts)) AS BIGINT) AS valid_from,
         CASE WHEN event_id % 5 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 3600 * (1 + event_id % 24) END AS valid_to,
         event_id AS tx_from, CASE WHEN event_id % 10 = 0 THEN event_id + 500 END AS tx_to, 50 + event_id % 50 AS pct,
         'source-' || (event_id % {NDOCS}) AS source,
         CASE WHEN user_id % 3 <> 0 THEN 'tenant:' || (user_id % 3) END AS context,
         CASE WHEN event_id % 10 = 0 THEN 'Retracted' ELSE 'Active' END AS status
  FROM events)"""
LOCATED = """located AS (
  SELECT 'loc-customer-' || c_custkey AS id, 'customer-' || c_custkey AS subject, 'nation-' || c_nationkey AS object, CAST(c_custkey AS BIGINT) AS tx_from FROM customer
  UNION ALL SELECT 'loc-supplier-' || s_suppkey, 'supplier-' || s_suppkey, 'nation-' || s_nationkey, s_suppkey FROM supplier
  UNION ALL SELECT 'loc-nation-' || n_nationkey, 'nation-' || n_nationkey, 'region-' || n_regionkey, n_nationkey FROM nation)"""
PLACED = """placed AS (
  SELECT 'placed-' || o_orderkey AS id, 'customer-' || o_custkey AS subject, 'order-' || o_orderkey AS object,
         CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS valid_from, o_orderkey AS tx_from,
         95 - 5 * coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 0) AS pct FROM orders)"""
SUPPLIED = """supplied AS (
  SELECT 'supplied-' || l_partkey || '-' || l_suppkey AS id, 'part-' || l_partkey AS subject, 'supplier-' || l_suppkey AS object,
         min(CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT)) AS valid_from,
         CASE WHEN max(CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT)) > min(CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT)) THEN max(CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT)) END AS valid_to,
         min(l_orderkey) AS tx_from, 60 + least(count(*), 39) AS pct
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
ENTITIES = """entities AS (
  SELECT 'customer-' || c_custkey AS id, 'Person' AS entity_type, c_name AS canonical_name FROM customer
  UNION ALL SELECT 'supplier-' || s_suppkey, 'Organization', s_name FROM supplier
  UNION ALL SELECT 'nation-' || n_nationkey, 'Place', n_name FROM nation
  UNION ALL SELECT 'region-' || r_regionkey, 'Place', r_name FROM region
  UNION ALL SELECT 'part-' || p_partkey, 'Custom(Part)', p_name FROM part
  UNION ALL SELECT 'order-' || o_orderkey, 'Event', NULL FROM orders
  UNION ALL SELECT DISTINCT 'user-' || user_id, 'Person', NULL FROM events WHERE user_id IS NOT NULL)"""
TRUST = "CASE quality WHEN 1 THEN 90 WHEN 0 THEN 40 END"
SOURCES = f"""sources AS (
  SELECT 'source-' || d.doc_id AS id, d.doc_id AS observed_at, d.source AS uri, d.text, {TRUST} AS trust_pct
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LINKS = """links AS (
  SELECT event_id AS cause, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS effect, event_type AS mechanism, 50 + event_id % 50 AS pct
  FROM events QUALIFY effect IS NOT NULL)"""
OVERLAP = "l.subject = r.subject AND l.context IS NOT DISTINCT FROM r.context AND l.id < r.id AND (r.valid_to IS NULL OR l.valid_from < r.valid_to) AND (l.valid_to IS NULL OR r.valid_from < l.valid_to)"
REPLACES = "l.obj_text = r.obj_text AND ((l.status = 'Active' AND r.status <> 'Active' AND l.pct > r.pct) OR (r.status = 'Active' AND l.status <> 'Active' AND r.pct > l.pct))"
SCALARS = "l.status = 'Active' AND r.status = 'Active' AND l.obj_text <> r.obj_text"
CONFLICTS = f"""conflicts AS (
  SELECT CASE WHEN {REPLACES} AND r.status = 'Active' THEN r.id ELSE l.id END AS assertion_a,
         CASE WHEN {REPLACES} AND r.status = 'Active' THEN l.id ELSE r.id END AS assertion_b,
         CASE WHEN {REPLACES} THEN 'LowerConfidenceReplacement' ELSE 'IncompatibleScalarValues' END AS type
  FROM state l JOIN state r ON {OVERLAP} AND ({REPLACES} OR ({SCALARS})))"""
SHOWN = "id, subject, obj_text, valid_from, valid_to, tx_from, pct, context, status"
_SHOWN = SHOWN.split(", ")


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a function of the graph under its name, with its SQL behind common tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return register


# selection


@query(f"SELECT {SHOWN} FROM state WHERE subject = 'user-7' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= 9000 AND (tx_to IS NULL OR tx_to > 9000) AND pct >= 60 ORDER BY id LIMIT 50", STATE)
def find_state_at(g: Graph) -> DataFrame:
    q = sx.GraphQuery(subject="user-7", predicate="STATE", valid_at=V, known_at=9000, min_confidence=0.6, limit=50)
    return sx.find(g.state(), q).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE subject = 'user-7' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= 9000 AND (tx_to IS NULL OR tx_to > 9000) AND pct >= 60 ORDER BY id LIMIT 20", STATE)
def lang_find(g: Graph) -> DataFrame:
    engine = lang.Engine(g.state(), g.entities(), g.causal_links())
    return engine.run(f'FIND Id("user-7") WHERE STATE VALID_AT {V} KNOWN_AT 9000 MIN_CONFIDENCE 0.6 LIMIT 20').select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE status = 'Active' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= {K} AND (tx_to IS NULL OR tx_to > {K})", STATE)
def visible_at(g: Graph) -> DataFrame:
    return sx.visible_at(g.state(), V, K).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE status = 'Active' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V})", STATE)
def valid_at(g: Graph) -> DataFrame:
    return sx.valid_at(g.state(), V).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE tx_from <= {K} AND (tx_to IS NULL OR tx_to > {K})", STATE)
def known_at_any_status(g: Graph) -> DataFrame:
    return sx.known_at(g.state(), K).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE status = 'Active' AND tx_from <= {K} AND (tx_to IS NULL OR tx_to > {K})", STATE)
def known_at_active(g: Graph) -> DataFrame:
    return sx.known_at(g.state(), K, active_only=True).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE tx_from BETWEEN 500 AND 700 OR tx_to BETWEEN 500 AND 700", STATE)
def changed_between(g: Graph) -> DataFrame:
    return sx.changed_between(g.state(), 500, 700).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE status = 'Active' AND valid_from < {V + DAY} AND (valid_to IS NULL OR {V} < valid_to)", STATE)
def active_during(g: Graph) -> DataFrame:
    return sx.active_during(g.state(), V, V + DAY).select(*_SHOWN)


@query(f"SELECT {SHOWN} FROM state WHERE status <> 'Active' AND (tx_to > 600 OR tx_from > 600)", STATE)
def superseded_after(g: Graph) -> DataFrame:
    return sx.superseded_after(g.state(), 600).select(*_SHOWN)


@query("SELECT id, subject, object AS obj_entity, tx_from FROM located WHERE subject = 'nation-3' OR object = 'nation-3'", LOCATED)
def adjacent_at(g: Graph) -> DataFrame:
    return sx.adjacent_at(g.located(), "nation-3", 20000101).select("id", "subject", "obj_entity", "tx_from")


@query("SELECT l.id, l.subject, l.object AS obj_entity, s.canonical_name AS subject_name, o.canonical_name AS object_name FROM located l LEFT JOIN entities s ON s.id = l.subject LEFT JOIN entities o ON o.id = l.object WHERE l.subject = 'nation-3' OR l.object = 'nation-3'", LOCATED, ENTITIES)
def timeline(g: Graph) -> DataFrame:
    return sx.timeline(g.located(), g.entities(), "nation-3").select("id", "subject", "obj_entity", "subject_name", "object_name")


@query(f"SELECT {SHOWN} FROM state WHERE source = 'source-11'", STATE)
def by_source(g: Graph) -> DataFrame:
    return sx.by_source(g.state(), "source-11").select(*_SHOWN)


@query("SELECT CAST(least(pct // 10, 10) AS INTEGER) AS bucket, count(*) AS n FROM state GROUP BY 1", STATE)
def confidence_buckets(g: Graph) -> DataFrame:
    return ax.confidence_buckets(g.state())


@query(f"SELECT context, count(*) AS n FROM state WHERE status = 'Active' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) GROUP BY context", STATE)
def state_by_context(g: Graph) -> DataFrame:
    return sx.valid_at(g.state(), V).groupBy("context").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (obj_text = 'click') AS supporting, count(*) FILTER (obj_text <> 'click') AS opposing, CASE WHEN count(*) FILTER (obj_text <> 'click') > 0 THEN 'Contradicted' WHEN count(*) FILTER (obj_text = 'click') > 0 THEN 'Supported' ELSE 'InsufficientEvidence' END AS verdict FROM state WHERE subject = 'user-7' AND status = 'Active' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V})", STATE)
def verify_claim(g: Graph) -> DataFrame:
    return sx.verify(g.state(), "user-7", "STATE", "click", V)


# joins over intervals

ALLEN_SQL = """
SELECT CASE WHEN l.valid_from = r.valid_from AND l.valid_to IS NOT DISTINCT FROM r.valid_to THEN 'equals'
  WHEN l.valid_to < r.valid_from THEN 'before' WHEN r.valid_to < l.valid_from THEN 'after' WHEN l.valid_to = r.valid_from THEN 'meets'
  WHEN l.valid_from = r.valid_from AND l.valid_to IS NOT NULL AND (r.valid_to IS NULL OR l.valid_to < r.valid_to) THEN 'starts'
  WHEN r.valid_from < l.valid_from AND l.valid_to IS NOT DISTINCT FROM r.valid_to THEN 'finishes'
  WHEN r.valid_from < l.valid_from AND l.valid_to IS NOT NULL AND (r.valid_to IS NULL OR l.valid_to < r.valid_to) THEN 'during'
  WHEN l.valid_from < r.valid_from AND r.valid_to IS NOT NULL AND (l.valid_to IS NULL OR r.valid_to < l.valid_to) THEN 'contains'
  WHEN l.valid_from < r.valid_from AND (l.valid_to IS NULL OR r.valid_from < l.valid_to) AND l.valid_to IS NOT NULL AND (r.valid_to IS NULL OR l.valid_to < r.valid_to) THEN 'overlaps'
  ELSE 'none' END AS relation, count(*) AS n
FROM state l JOIN state r ON l.subject = r.subject AND l.context IS NOT DISTINCT FROM r.context AND l.id < r.id GROUP BY 1"""


@query(ALLEN_SQL, STATE)
def allen_histogram(g: Graph) -> DataFrame:
    return cx.allen_histogram(g.state())


@query("SELECT * FROM conflicts", STATE, CONFLICTS)
def contradictions(g: Graph) -> DataFrame:
    return cx.contradictions(g.state()).select("assertion_a", "assertion_b", "type")


@query("SELECT * FROM conflicts", STATE, CONFLICTS)
def contradictions_binned(g: Graph) -> DataFrame:
    """The same with bins of valid time in the join's key, for very hot subjects."""
    return cx.contradictions(g.state(), bin_width=7 * DAY, last=END + 30 * DAY).select("assertion_a", "assertion_b", "type")


@query("SELECT type, CASE type WHEN 'LowerConfidenceReplacement' THEN 'Low' ELSE 'Medium' END AS severity, count(*) AS n FROM conflicts GROUP BY type", STATE, CONFLICTS)
def contradictions_by_type(g: Graph) -> DataFrame:
    return cx.contradictions(g.state()).groupBy("type", "severity").agg(F.count("*").alias("n"))


EVIDENCE_SQL = """
SELECT c.*, a.source AS source_a, b.source AS source_b, sa.trust_pct AS trust_a, sb.trust_pct AS trust_b
FROM conflicts c JOIN state a ON a.id = c.assertion_a JOIN state b ON b.id = c.assertion_b
LEFT JOIN sources sa ON sa.id = a.source LEFT JOIN sources sb ON sb.id = b.source"""


@query(EVIDENCE_SQL, STATE, CONFLICTS, SOURCES)
def contradictions_with_evidence(g: Graph) -> DataFrame:
    """The flagship: every contradiction with both sides' sources and how far they are trusted."""
    found = cx.contradictions(g.state()).select("assertion_a", "assertion_b", "type")
    one = g.state().select("id", F.element_at("source_ids", 1).alias("source"))
    trust = one.join(g.sources().select(F.col("id").alias("source"), "trust_pct"), "source", "left")
    side = lambda s: trust.select(F.col("id").alias(f"assertion_{s}"), F.col("source").alias(f"source_{s}"), F.col("trust_pct").alias(f"trust_{s}"))
    return found.join(side("a"), "assertion_a").join(side("b"), "assertion_b").select("assertion_a", "assertion_b", "type", "source_a", "source_b", "trust_a", "trust_b")


@query("SELECT l.id AS claim_a, r.id AS claim_b, CASE WHEN l.object = r.object THEN 'SourceTrustDisagreement' ELSE 'ValidTimeOverlapConflict' END AS type FROM supplied l JOIN supplied r ON l.subject = r.subject AND l.id < r.id AND l.object <> r.object AND (r.valid_to IS NULL OR l.valid_from < r.valid_to) AND (l.valid_to IS NULL OR r.valid_from < l.valid_to)", SUPPLIED)
def claim_conflicts(g: Graph) -> DataFrame:
    """Suppliers of the same part at the same time."""
    claims = g.supplied().withColumn("trust_pct", F.lit(50.0))
    return cx.claim_conflicts(claims)


SCORED = f"""claims AS (
  SELECT s.*, coalesce(t.trust_pct, 50) AS trust, 250000 * CAST(s.pct AS BIGINT) + 700000 * CAST(coalesce(t.trust_pct, 50) AS BIGINT) + 5 * least(greatest(tx_from, 0), 1000000) AS score
  FROM state s LEFT JOIN sources t ON t.id = s.source)"""


@query(f"SELECT subject, id, CAST(count(*) OVER (PARTITION BY subject) - 1 AS BIGINT) AS competing, score / 100000000.0::DOUBLE AS score FROM claims WHERE valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= 900 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY score DESC, tx_from DESC, id) = 1", STATE, SOURCES, SCORED)
def preferred_claim(g: Graph) -> DataFrame:
    claims = bx.average_trust(g.state(), g.sources(), 50)
    best = bx.preferred_claim(claims, V, 900)
    return best.select("subject", "id", F.col("competing").cast("long").alias("competing"), bx.claim_score().alias("score"))


@query("""SELECT subject, known_at, previous, next FROM (
  SELECT subject, tx_from AS known_at, next, lag(next) OVER (PARTITION BY subject ORDER BY tx_from, id) AS previous, rn FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY tx_from, id) AS rn,
      last_value(CASE WHEN best THEN id END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY tx_from, id ROWS UNBOUNDED PRECEDING) AS next FROM (
      SELECT *, score >= max(score) OVER (PARTITION BY subject ORDER BY tx_from, id ROWS UNBOUNDED PRECEDING) AS best FROM claims)))
WHERE next IS DISTINCT FROM previous""", STATE, SOURCES, SCORED)
def belief_revisions(g: Graph) -> DataFrame:
    claims = bx.average_trust(g.state(), g.sources(), 50)
    return bx.belief_revisions(claims, ["subject"]).select("subject", "known_at", "previous", "next")


def _atoms(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Atoms out of events: those retracted were accepted until their transaction time's end."""
    a = g.state().select(F.col("id").alias("atom_id"), "subject", "predicate", F.col("obj_text").alias("object"), "valid_from", "valid_to", "tx_from", "tx_to", F.when(F.col("status") == "Active", "Accepted").otherwise("Retracted").alias("belief"))
    r = a.filter("tx_to is not null").select("atom_id", F.lit(1).alias("seq"), F.col("tx_to").alias("known_at"), F.lit("Accepted").alias("previous"), F.lit("Retracted").alias("next"))
    return a, r


@query("SELECT id AS atom_id, CASE WHEN tx_to > 800 THEN 'Accepted' WHEN status = 'Active' THEN 'Accepted' ELSE 'Retracted' END AS belief FROM state", STATE)
def belief_as_of(g: Graph) -> DataFrame:
    return bx.belief_at(*_atoms(g), 800)


@query(f"SELECT id AS atom_id, object, belief_then FROM (SELECT id, obj_text AS object, CASE WHEN tx_to > 9800 OR status = 'Active' THEN 'Accepted' ELSE 'Retracted' END AS belief_then FROM state WHERE subject = 'user-7' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V}) AND tx_from <= 9800 AND (tx_to IS NULL OR tx_to > 9800))", STATE)
def kernel_entity_state(g: Graph) -> DataFrame:
    a, r = _atoms(g)
    return kx.entity_state(a, r, "user-7", V, 9800).select("atom_id", "object", "belief_then")


@query("SELECT 'part-' || a AS entity_a, 'part-' || b AS entity_b FROM (SELECT min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS a, p_partkey AS b FROM part QUALIFY a <> b)")
def duplicate_entities(g: Graph) -> DataFrame:
    key = F.md5(F.concat_ws("|", fx.normalize_name(F.col("p_name")), "p_brand", "p_type", F.col("p_size").cast("string")))
    parts = g.raw("part").select(F.col("p_partkey").alias("id"), key.alias("k"))
    return cx.duplicate_entities(parts, ["k"]).select(F.concat(F.lit("part-"), F.col("entity_a").cast("string")).alias("entity_a"), F.concat(F.lit("part-"), F.col("entity_b").cast("string")).alias("entity_b"))


@query("SELECT p.id, p.object AS obj_entity FROM placed p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus <> 'P' AND 'order-' || o.o_orderkey = p.object)", PLACED)
def broken_relationships(g: Graph) -> DataFrame:
    """Orders that customers placed but that are no entity, if pending orders are none."""
    have = g.raw("orders").filter("o_orderstatus != 'P'").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"))
    return cx.broken_relationships(g.placed(), have)


@query("SELECT 'customer-' || c_custkey AS subject FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority LIKE '1%')")
def missing_facts(g: Graph) -> DataFrame:
    """Customers without an urgent order."""
    need = g.raw("customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("subject"))
    return ax.missing_facts(need, g.placed().filter("pct = 90"), ["subject"])


@query("SELECT id, subject FROM state WHERE status = 'Active' AND (tx_from > 200 OR tx_to > 200) AND 900 - tx_from >= 300", STATE)
def stale_facts(g: Graph) -> DataFrame:
    return ax.stale_assertions(g.state(), 200, 900, 300).select("id", "subject")


CONCURRENT = """SELECT subject, predicate, CAST(max(n) AS BIGINT) AS most FROM (
  SELECT subject, predicate, sum(d) OVER (PARTITION BY subject ORDER BY t) AS n FROM (
    SELECT subject, predicate, t, sum(d) AS d FROM (
      SELECT subject, predicate, valid_from AS t, 1 AS d FROM state UNION ALL SELECT subject, predicate, valid_to, -1 FROM state WHERE valid_to IS NOT NULL)
    GROUP BY ALL)) GROUP BY subject, predicate"""


@query(CONCURRENT, STATE)
def max_concurrent(g: Graph) -> DataFrame:
    return cx.max_concurrent_objects(g.state()).withColumn("most", F.col("most").cast("long"))


# evidence packs, governance

PACKED = f"""picked AS (SELECT * FROM state WHERE subject = 'user-7' AND valid_from <= {V} AND (valid_to IS NULL OR valid_to > {V})),
near AS (SELECT * FROM conflicts WHERE assertion_a IN (SELECT id FROM picked) OR assertion_b IN (SELECT id FROM picked)),
members AS (SELECT id FROM picked UNION SELECT assertion_a FROM near UNION SELECT assertion_b FROM near),
pack AS (SELECT * FROM state WHERE id IN (SELECT id FROM members))"""


def _pack(g: Graph) -> pk.Pack:
    # a contradiction has one subject, so only the subject's own rows can be in its pack
    own = g.state().filter("subject = 'user-7'")
    picked = own.filter(tm.valid_at(V))
    return pk.evidence_pack(picked, own, g.entities(), g.sources(), cx.contradictions(own))


@query("SELECT id, subject, obj_text FROM pack", STATE, CONFLICTS, PACKED)
def evidence_pack_assertions(g: Graph) -> DataFrame:
    return _pack(g).assertions.select("id", "subject", "obj_text")


@query("SELECT id, uri, trust_pct FROM sources WHERE id IN (SELECT source FROM pack)", STATE, CONFLICTS, PACKED, SOURCES)
def evidence_pack_sources(g: Graph) -> DataFrame:
    return _pack(g).sources.select("id", "uri", "trust_pct")


@query("SELECT id, entity_type FROM entities WHERE id IN (SELECT subject FROM pack)", STATE, CONFLICTS, PACKED, ENTITIES)
def evidence_pack_entities(g: Graph) -> DataFrame:
    return _pack(g).entities.select("id", "entity_type")


@query("SELECT assertion_a, assertion_b, type FROM near", STATE, CONFLICTS, PACKED)
def evidence_pack_contradictions(g: Graph) -> DataFrame:
    return _pack(g).contradictions.select("assertion_a", "assertion_b", "type")


@query("SELECT id, subject FROM state WHERE context = 'tenant:1' AND source NOT IN (SELECT id FROM sources WHERE trust_pct < 50)", STATE, SOURCES)
def governed_assertions(g: Graph) -> DataFrame:
    return pk.governed(g.state(), "1", g.sources().filter("trust_pct < 50")).select("id", "subject")


@query("SELECT CASE WHEN context IS DISTINCT FROM 'tenant:1' THEN 'denied-tenant' WHEN source IN (SELECT id FROM sources WHERE trust_pct < 50) THEN 'denied-source' ELSE 'allowed' END AS decision, count(*) AS n FROM state GROUP BY 1", STATE, SOURCES)
def governance_audit(g: Graph) -> DataFrame:
    return pk.audit(g.state(), "1", g.sources().filter("trust_pct < 50")).groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN uri IN ('src3', 'src4') THEN '[REDACTED]' ELSE uri END AS uri, CASE WHEN uri IN ('src4', 'src5') THEN '[REDACTED]' ELSE md5(text) END AS content_hash FROM sources WHERE uri IS DISTINCT FROM 'src7'", SOURCES)
def redacted_sources(g: Graph) -> DataFrame:
    s = g.sources()
    rule = lambda mode, *uris: s.filter(F.col("uri").isin(*uris)).select("id", F.lit(mode).alias("mode"))
    return pk.redacted(s, rule("uri", "src3", "src4").union(rule("hash", "src4", "src5")).union(rule("delete", "src7"))).select("id", "uri", "content_hash")


@query("SELECT subject || '|' || obj_text AS fact, side FROM (SELECT subject, obj_text, CASE WHEN a AND NOT b THEN 'left' WHEN b AND NOT a THEN 'right' END AS side FROM (SELECT subject, obj_text, bool_or(context IS NULL) AS a, bool_or(context IS NOT DISTINCT FROM 'tenant:1') AS b FROM (SELECT subject, obj_text, context FROM state) GROUP BY ALL)) WHERE side IS NOT NULL", STATE)
def knowledge_delta(g: Graph) -> DataFrame:
    s = g.state()
    d = pk.knowledge_delta(s.filter("context is null"), s.filter("context = 'tenant:1'"), ["subject", "obj_text"])
    return d.select(F.concat_ws("|", "subject", "obj_text").alias("fact"), "side")


@query("SELECT id, 'users' AS graph, round(pct / 100.0 * 0.9, 6) AS weighted FROM state UNION ALL SELECT id, 'places', round(0.9 * 0.5, 6) FROM located", STATE, LOCATED)
def federated_union(g: Graph) -> DataFrame:
    out = pk.federated({"users": (g.state(), 0.9, True), "places": (g.located(), 0.5, True), "orders": (g.placed(), 1.0, False)})
    return out.select("id", "graph", "weighted")


@query("SELECT obj_text, count(*) AS n FROM state GROUP BY obj_text HAVING count(*) >= 5", STATE)
def private_counts(g: Graph) -> DataFrame:
    return pk.k_anonymous_counts(g.state(), "obj_text", 5)


# graph

HOPS = """
SELECT 'customer-' || c_custkey AS start, 'region-' || n_regionkey AS "end", 'loc-customer-' || c_custkey || '>loc-nation-' || n_nationkey AS hops, 2 AS length
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _customers(g: Graph) -> DataFrame:
    return g.raw("customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"))


@query(HOPS)
def paths_customer_region(g: Graph) -> DataFrame:
    starts = _customers(g)
    p = gx.paths(gx.edges(g.located()), starts, 3).filter("startswith(`end`, 'region-')")
    return p.select("start", "end", F.array_join("hops", ">").alias("hops"), "length")


@query("""SELECT 'customer-' || o_custkey AS start, 'order-' || o_orderkey AS "end", 'placed-' || o_orderkey AS hops, 1 AS length FROM orders
UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'loc-customer-' || c_custkey, 1 FROM customer
UNION ALL SELECT 'customer-' || c_custkey, 'region-' || n_regionkey, 'loc-customer-' || c_custkey || '>loc-nation-' || n_nationkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def paths_via_set(g: Graph) -> DataFrame:
    starts = _customers(g)
    both = gx.edges(g.located()).unionByName(gx.edges(g.placed()))
    p = gx.paths(both, starts, 2, predicates=["LOCATED_IN", "PLACED"], positional=False)
    return p.select("start", "end", F.array_join("hops", ">").alias("hops"), "length")


@query("""SELECT 'customer-' || c_custkey AS start, 'nation-' || c_nationkey AS "end", 'loc-customer-' || c_custkey AS hops, 1 AS length FROM customer
UNION ALL SELECT 'customer-' || c_custkey, 'region-' || n_regionkey, 'loc-customer-' || c_custkey || '>loc-nation-' || n_nationkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def paths_positional(g: Graph) -> DataFrame:
    starts = _customers(g)
    p = gx.paths(gx.edges(g.located()), starts, 5, predicates=["LOCATED_IN", "LOCATED_IN"])
    return p.select("start", "end", F.array_join("hops", ">").alias("hops"), "length")


def _dependencies(g: Graph) -> DataFrame:
    """(a, b): customers depend on orders, orders on their suppliers."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    o = g.raw("orders").select(key("order", "o_orderkey").alias("a"), key("customer", "o_custkey").alias("b"))
    s = g.raw("lineitem").select(key("supplier", "l_suppkey").alias("a"), key("order", "l_orderkey").alias("b")).distinct()
    return o.union(s)


DEPS = "deps AS (SELECT 'order-' || o_orderkey AS a, 'customer-' || o_custkey AS b FROM orders UNION SELECT DISTINCT 'supplier-' || l_suppkey, 'order-' || l_orderkey FROM lineitem)"


@query("SELECT 'supplier-3' AS root, b AS node, min(depth) AS depth FROM r GROUP BY b", DEPS, "r AS (SELECT a, b, 1 AS depth FROM deps WHERE a = 'supplier-3' UNION SELECT d.a, d.b, r.depth + 1 FROM r JOIN deps d ON d.a = r.b)", recursive=True)
def closure_impact(g: Graph) -> DataFrame:
    root = g.spark.createDataFrame([("supplier-3",)], "id string")
    return gx.reachable(_dependencies(g), root)


@query("SELECT split_part(b, '-', 1) AS kind, count(DISTINCT b) AS n FROM r GROUP BY 1", DEPS, "r AS (SELECT a, b FROM deps WHERE a = 'supplier-5' UNION SELECT d.a, d.b FROM r JOIN deps d ON d.a = r.b)", recursive=True)
def impact_if_retracted(g: Graph) -> DataFrame:
    d = _dependencies(g).select(F.col("b").alias("from_id"), F.col("a").alias("to_id"))
    root = g.spark.createDataFrame([("supplier-5",)], "id string")
    return kx.impact_if_retracted(d, root).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT node, min(depth) AS depth FROM r GROUP BY node", DEPS, "r AS (SELECT 'supplier-3' AS node, 0 AS depth UNION SELECT d.b, r.depth + 1 FROM r JOIN deps d ON d.a = r.node WHERE r.depth < 2)", recursive=True)
def bfs_depths(g: Graph) -> DataFrame:
    root = g.spark.createDataFrame([("supplier-3",)], "id string")
    return gx.bfs(_dependencies(g), root, 2)


CAUSAL_DOWN = "w AS (SELECT l.cause AS start, l.effect AS \"end\", l.cause || '>' || l.effect AS path, 1 AS length, CAST(l.pct AS BIGINT) AS c FROM links l UNION ALL SELECT w.start, l.effect, w.path || '>' || l.effect, w.length + 1, w.c * l.pct FROM w JOIN links l ON l.cause = w.\"end\" WHERE w.length < 4)"


@query('SELECT start, "end", path, length, c / CAST(100 ** length AS DOUBLE) AS confidence FROM w', LINKS, CAUSAL_DOWN, recursive=True)
def effects_of(g: Graph) -> DataFrame:
    start = g.raw("events").select(F.col("event_id").cast("long").alias("id"))
    return gx.causal_paths(g.causal_links(), start, 4, rule="raw")


@query('SELECT start, "end", path, length, least(c1, c2, c3) AS confidence FROM (SELECT a.cause AS start, c.effect AS "end", a.cause || \'>\' || b.cause || \'>\' || c.cause || \'>\' || c.effect AS path, 3 AS length, CAST(a.pct AS DOUBLE) / 100 AS c1, CAST(b.pct AS DOUBLE) / 100 AS c2, CAST(c.pct AS DOUBLE) / 100 AS c3 FROM links a JOIN links b ON b.cause = a.effect JOIN links c ON c.cause = b.effect)', LINKS)
def causal_min_conf(g: Graph) -> DataFrame:
    end = g.raw("events").select(F.col("event_id").cast("long").alias("id"))
    return gx.causal_paths(g.causal_links(), end, 3, reverse=True, rule="min").filter("length = 3")


@query('SELECT cause AS start, effect AS "end", cause || \'>\' || effect AS path, 1 AS length, CAST(pct AS DOUBLE) / 100 AS confidence FROM links', LINKS)
def causes_of(g: Graph) -> DataFrame:
    end = g.raw("events").select(F.col("event_id").cast("long").alias("id"))
    return gx.causal_paths(g.causal_links(), end, 1, reverse=True)


@query("SELECT node, depth, side FROM (SELECT node, depth, 'downstream' AS side FROM d WHERE depth > 0 UNION ALL SELECT node, depth, 'upstream' FROM u WHERE depth > 0)", LINKS, "d AS (SELECT CAST(500 AS BIGINT) AS node, 0 AS depth UNION SELECT l.effect, d.depth + 1 FROM d JOIN links l ON l.cause = d.node WHERE d.depth < 3)", "u AS (SELECT CAST(500 AS BIGINT) AS node, 0 AS depth UNION SELECT l.cause, u.depth + 1 FROM u JOIN links l ON l.effect = u.node WHERE u.depth < 3)", recursive=True)
def counterfactual_remove_event(g: Graph) -> DataFrame:
    engine = lang.Engine(g.state(), g.entities(), g.causal_links())
    return engine.run('COUNTERFACTUAL REMOVE EVENT("500") MAX_DEPTH 3').select("node", "depth", "side")


REGIONS = """places AS (
  SELECT 'customer-' || c_custkey AS node, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier-' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'nation-' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'region-' || n_regionkey, n_regionkey FROM nation),
members AS (SELECT node, min(node) OVER (PARTITION BY region) AS root FROM places)"""


def _regions(g: Graph) -> DataFrame:
    return gx.components(g.located().select(F.col("subject").alias("a"), F.col("obj_entity").alias("b")))


@query("SELECT node, root FROM members", REGIONS)
def communities(g: Graph) -> DataFrame:
    """Components of everything that lies in something: one for each region."""
    return _regions(g)


@query(f"""SELECT c.root, c.entities, a.assertions, a.tx_start, a.sources FROM (SELECT root, count(*) AS entities FROM members GROUP BY root) c
JOIN (SELECT root, count(*) AS assertions, max(tx_from) AS tx_start, count(DISTINCT tx_from % {NDOCS}) AS sources FROM located JOIN members ON node = subject GROUP BY root) a ON a.root = c.root""", LOCATED, REGIONS)
def community_summary(g: Graph) -> DataFrame:
    return gx.community_summary(g.located(), _regions(g)).select("root", "entities", "assertions", "tx_start", "sources")


@query()
def ppr_top10(g: Graph) -> DataFrame:
    """The ten places and people closest to region 1, by ranks with restart."""
    e = gx.edges(g.located())
    both = e.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(e.select(F.col("object").alias("a"), F.col("subject").alias("b")))
    ranks = gx.personalized_page_rank(both, g.spark.createDataFrame([("region-1", 1.0)], "id string, weight double"))
    return ranks.select("node", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node").limit(10)


# vectors and memories


@query("""SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
  SELECT 'vec-' || v.vec_id AS id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, id LIMIT 25""")
def knn_cosine(g: Graph) -> DataFrame:
    v = g.vectors()
    return mx.knn(v, v.filter("vec_id = 0"), 25)


QUESTION = "the and of"


@query(f"""SELECT id, round(hits / 3.0 * CASE WHEN nxt IS NULL THEN 1.0 ELSE 0.15 END, 6) AS score FROM (
  SELECT 'mem-' || conv_id || '-' || turn AS id, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt,
    len(list_intersect(['the', 'and', 'of'], list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')))) AS hits
  FROM conversations) WHERE hits > 0 ORDER BY score DESC, id LIMIT 40""")
def memory_retrieval(g: Graph) -> DataFrame:
    return mx.retrieve(g.memories(), QUESTION, 40)


@query("SELECT 'mem-' || conv_id || '-' || turn AS id, role AS agent_id FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user' AND turn <= 2 AND nxt IS NULL")
def memories_visible(g: Graph) -> DataFrame:
    return sx.memory_visible(g.memories(), "user", 2).select("id", "agent_id")


@query("SELECT id, max(t) AS last FROM (SELECT subject AS id, tx_from AS t FROM located UNION ALL SELECT object, tx_from FROM located) GROUP BY id ORDER BY last DESC, id LIMIT 30", LOCATED)
def recent_entities(g: Graph) -> DataFrame:
    return mx.recent_entities(g.located(), 30)


# aggregates


@query("""SELECT 'user-' || user_id AS source_id, count(*) FILTER (event_type = 'purchase') AS accurate, count(*) AS total,
  round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('purchase', 'error', 'view')), 0), 6) AS accuracy FROM events GROUP BY 1""")
def reputation(g: Graph) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "accurate").when(F.col("event_type") == "error", "inaccurate").when(F.col("event_type") == "view", "conflict").otherwise("other")
    e = g.raw("events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source_id"), kind.alias("kind"))
    r = bx.reputation(e)
    judged = F.col("accurate") + F.col("inaccurate") + F.col("conflicts")
    return r.select("source_id", "accurate", "total", F.when(judged > 0, F.round("accuracy", 6)).alias("accuracy"))


@query("""SELECT 'source-' || doc_id AS id, round(0.08 * base + 0.12 * 0.25 + 0.16 * 0.5 + 0.14 * 0.45 + 0.08 / (1 + greatest(1000 - doc_id, 0) / 1000.0) + 0.10 * 0.35 + 0.08 * (0.25 + 0.75 * 0.35) + 0.06 + 0.04 + 0.02 * 0.5, 6) AS trust
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0.74 WHEN 1 THEN 0.48 WHEN 2 THEN 0.82 WHEN 3 THEN 0.76 WHEN 4 THEN 0.58 ELSE 0.72 END AS base FROM documents)""")
def source_trust(g: Graph) -> DataFrame:
    """Trust of unverified sources without a history."""
    zero = F.lit(0.0)
    t = g.sources().select("id", "source_type", "observed_at", F.lit(False).alias("verified"), F.lit(False).alias("signed"), F.lit(0.5).alias("accuracy"), F.lit(0.45).alias("authority"), bx.independence(F.lit(1), F.lit(0)).alias("independence"), zero.alias("conflict_rate"), zero.alias("tamper"), zero.alias("human_delta"))
    return bx.score_source(t, 1000).select("id", F.round("trust", 6).alias("trust"))


HEALTH = f"""counts AS (SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM state) AS assertions, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM conflicts) AS contradictions,
  (SELECT count(*) FROM sources WHERE trust_pct < 50) AS low_trust, (SELECT count(*) FROM state WHERE status = 'Active' AND tx_from < {K}) AS stale,
  (SELECT count(*) FROM placed WHERE object NOT IN (SELECT id FROM entities)) AS broken, (SELECT count(*) - count(DISTINCT (p_name, p_brand, p_type, p_size)) FROM part) AS duplicates)"""


@query("SELECT *, greatest(0, least(1, 1 - 0.05 * (duplicates + stale + contradictions + broken + low_trust)))::DOUBLE AS health FROM counts", STATE, CONFLICTS, ENTITIES, SOURCES, PLACED, HEALTH)
def graph_health(g: Graph) -> DataFrame:
    s = g.state()
    parts = g.raw("part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size")
    return ax.graph_health(g.entities(), s, g.sources(), cx.duplicate_entities(parts, ["p_name", "p_brand", "p_type", "p_size"]), cx.contradictions(s), cx.broken_relationships(g.placed(), g.entities()), 50, K)


@query("SELECT 'LOCATED_IN' AS predicate, count(*) AS support, CAST(NULL AS VARCHAR) AS subject_type, 'Place' AS object_type, false AS temporal FROM located UNION ALL SELECT 'PLACED', count(*), 'Person', 'Event', false FROM placed UNION ALL SELECT 'SUPPLIED_BY', count(*), 'Custom(Part)', 'Organization', bool_or(valid_to IS NOT NULL) FROM supplied", LOCATED, PLACED, SUPPLIED)
def predicate_mining(g: Graph) -> DataFrame:
    return ax.predicate_mining(g.assertions(), g.entities(), ["STATE"])


@query("SELECT predicate, count(*) AS n, count(valid_to) AS bounded, round(1 - count(valid_to) / count(*), 6) AS open_ratio, round(avg(valid_to - valid_from), 6) AS mean_length FROM (SELECT 'STATE' AS predicate, valid_from, valid_to FROM state UNION ALL SELECT 'SUPPLIED_BY', valid_from, valid_to FROM supplied) GROUP BY predicate", STATE, SUPPLIED)
def temporal_patterns(g: Graph) -> DataFrame:
    return ax.temporal_patterns(g.state().union(g.supplied()))


@query("SELECT entity_type, count(*) AS members FROM entities WHERE entity_type NOT IN ('Person', 'Place') GROUP BY 1 HAVING count(*) >= 2", ENTITIES)
def type_clusters(g: Graph) -> DataFrame:
    return ax.type_clusters(g.entities(), ["Person", "Place"])


@query("SELECT subject, count(DISTINCT obj_text) AS objects FROM state GROUP BY subject HAVING count(DISTINCT obj_text) > 1", STATE)
def uncertain_facts(g: Graph) -> DataFrame:
    return ax.contradiction_rate(g.state()).select("subject", "objects")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(g: Graph) -> DataFrame:
    return ax.percentiles(g.raw("events"), "value", ["event_type"])


@query("SELECT event_type, round(avg(value), 6) AS score, count(*) AS cases, CAST(row_number() OVER (ORDER BY round(avg(value), 6) DESC, event_type) AS INTEGER) AS rank FROM events GROUP BY 1")
def leaderboard(g: Graph) -> DataFrame:
    return ax.leaderboard(g.raw("events"), "event_type", "value")


@query("SELECT user_id, round(avg(value), 6) AS mean_reward, count(*) AS pulls FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def bandit_best_arm(g: Graph) -> DataFrame:
    return ax.best_arm(g.raw("events"), "user_id", "value")


@query("""SELECT conv_id, round(CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(got, want)) / len(want) END, 6) AS recall FROM (
  SELECT conv_id, list_distinct(list(role)) AS got, ['user', 'assistant', 'system'] AS want FROM conversations GROUP BY conv_id)""")
def eval_metrics(g: Graph) -> DataFrame:
    t = g.raw("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("got"))
    recall, _, _ = ax.set_metrics(F.col("got"), F.array(F.lit("user"), F.lit("assistant"), F.lit("system")))
    return t.select("conv_id", F.round(recall, 6).alias("recall"))


@query("SELECT user_id AS arm, count(*) AS pulls, round(sum(value), 4) AS reward FROM events GROUP BY 1")
def bandit_arms(g: Graph) -> DataFrame:
    return ax.bandit_update(g.raw("events").withColumnRenamed("user_id", "arm"), "arm", "value").withColumn("reward", F.round("reward", 4))


# text


@query("""SELECT doc_id, score, score >= 65 AS quarantine FROM (SELECT doc_id, CAST(least(100,
  CASE WHEN contains(t, 'ignore previous') THEN 28 ELSE 0 END + CASE WHEN contains(t, 'system prompt') THEN 22 ELSE 0 END + CASE WHEN contains(t, 'hidden prompt') THEN 22 ELSE 0 END + CASE WHEN contains(t, 'exfiltrate') THEN 30 ELSE 0 END +
  CASE WHEN contains(t, 'api key') THEN 20 ELSE 0 END + CASE WHEN contains(t, 'api_key') THEN 20 ELSE 0 END + CASE WHEN contains(t, 'reveal') THEN 12 ELSE 0 END + CASE WHEN contains(t, 'disable safety') THEN 20 ELSE 0 END) AS INTEGER) AS score
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))""")
def injection_scan(g: Graph) -> DataFrame:
    return g.raw("documents").select("doc_id", fx.injection_risk(F.col("text")).cast("int").alias("score")).withColumn("quarantine", F.col("score") >= fx.QUARANTINE)


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(api[_-]?key|secret|password|token)\s*[=:]\s*\S+', '\1=[REDACTED]', 'g'), '\bsk-[A-Za-z0-9]{16,}\b', '[REDACTED]', 'g'), '\bAKIA[0-9A-Z]{16}\b', '[REDACTED]', 'g')) AS redacted FROM documents
WHERE regexp_matches(text, '(?i)\b(api[_-]?key|secret|password|token)\s*[=:]\s*\S+') OR regexp_matches(text, '\bsk-[A-Za-z0-9]{16,}\b') OR regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b')""")
def secret_redaction(g: Graph) -> DataFrame:
    return g.raw("documents").filter(ig.has_secret(F.col("text"))).select("doc_id", F.md5(ig.redact_secrets(F.col("text"))).alias("redacted"))


@query("SELECT page_id, title FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages) WHERE title <> ''")
def html_title(g: Graph) -> DataFrame:
    return ig.html_titles(g.raw("pages"))


@query("""SELECT doc_id AS id, count(*) AS chunks, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM (
  SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents) WHERE line <> '' GROUP BY 1""")
def line_chunks(g: Graph) -> DataFrame:
    c = ig.line_chunks(g.raw("documents").select("doc_id", "text"))
    return c.groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))


@query("SELECT doc_id, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS tokens FROM documents")
def estimate_tokens(g: Graph) -> DataFrame:
    return g.raw("documents").select("doc_id", fx.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT id, CASE WHEN slug = '' THEN 'unknown' ELSE slug END AS slug FROM (SELECT id, regexp_replace(regexp_replace(lower(canonical_name), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM entities WHERE canonical_name IS NOT NULL)", ENTITIES)
def slugs(g: Graph) -> DataFrame:
    return g.entities().filter("canonical_name is not null").select("id", fx.slugify(F.col("canonical_name")).alias("slug"))


# event log


@query("SELECT 'user-' || user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def replay_state(g: Graph) -> DataFrame:
    return ev.replay_latest(g.events_log().drop("ts")).select("key", "seq", "kind", "value")


@query("SELECT 'user-' || user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def snapshot_and_tail(g: Graph) -> DataFrame:
    log = g.events_log().drop("ts")
    return ev.snapshot_and_tail(ev.replay_latest(log.filter("seq <= 400")), log, 400).select("key", "seq", "kind", "value")


@query("SELECT CAST(event_id // 1000 AS BIGINT) AS segment, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1")
def log_segments(g: Graph) -> DataFrame:
    return ev.segments(g.events_log(), 1000).select("segment", "first", "last", "n")


@query("SELECT event_id AS seq FROM events WHERE event_type = 'purchase' AND event_id NOT IN (SELECT event_id + 1 FROM events WHERE event_type = 'purchase') AND event_id <> (SELECT min(event_id) FROM events WHERE event_type = 'purchase')")
def log_gaps(g: Graph) -> DataFrame:
    """Where the log of purchases doesn't follow on."""
    return ev.gaps(g.events_log().filter("kind = 'purchase'"))


@query("SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS tx FROM events")
def log_sequence(g: Graph) -> DataFrame:
    return ev.sequence(g.events_log().select("seq", "kind"), ["seq"]).select("seq", "tx")


@query("SELECT 'user-' || user_id AS key, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def incremental_equals_batch(g: Graph) -> DataFrame:
    """Counters maintained by a stream over the log, in micro-batches, read as one view."""
    from tempora.streaming import views
    from tempora.tables import shared_dir

    base = f"{shared_dir(g.spark)}/tempora-{g.spark.sparkContext.applicationId}/view-{uuid.uuid4().hex[:12]}"
    raw = g.raw("events")
    stream = g.spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(g.dir)
    log = stream.select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"))
    view = views.counters(f"{base}/counters")
    views.run(log, [view], f"{base}/checkpoint").awaitTermination()
    return view.read(g.spark)


@query(f"SELECT id FROM state WHERE subject = 'user-7' AND valid_from < {V} INTERSECT SELECT id FROM state WHERE pct > 70", STATE)
def candidate_set_ops(g: Graph) -> DataFrame:
    s = g.state()
    return s.filter(f"subject = 'user-7' and valid_from < {V}").select("id").intersect(s.filter("pct > 70").select("id"))


@query("SELECT rule, count(*) AS n FROM (SELECT id, 'unknown-source' AS rule FROM state WHERE source NOT IN (SELECT id FROM sources WHERE trust_pct IS NOT NULL)) GROUP BY rule", STATE, SOURCES)
def validation_rules(g: Graph) -> DataFrame:
    """Rules that assertions break if unrated sources don't count as known."""
    return ev.violations(g.state(), g.entities(), g.sources().filter("trust_pct is not null")).groupBy("rule").agg(F.count("*").alias("n"))



# ontology, maintenance, agents


@query("SELECT id, 'subject-type' AS rule FROM located WHERE subject NOT LIKE 'customer-%'", LOCATED)
def ontology_violations(g: Graph) -> DataFrame:
    """What breaks an ontology in which only persons lie in places."""
    return on.assertion_violations(g.located(), g.entities(), on.Ontology({}, {"LOCATED_IN": {"subject": "Person", "object": "Place"}}))


CHANGED = "changed AS (SELECT * FROM state WHERE tx_from > 600 OR tx_to > 600)"


@query("""SELECT job, count(*) AS n FROM (
  SELECT 'stale' AS job FROM changed WHERE status = 'Active' AND 20000 - tx_from >= 15000
  UNION ALL SELECT 'contradiction' FROM conflicts WHERE assertion_a IN (SELECT id FROM changed) OR assertion_b IN (SELECT id FROM changed)
  UNION ALL SELECT 'recompute-community' FROM (SELECT DISTINCT subject FROM changed)
  UNION ALL SELECT 'refresh-summary' FROM changed
  UNION ALL SELECT 'recalibrate-trust' FROM sources WHERE observed_at > 600 AND trust_pct < 50) GROUP BY job""", STATE, CONFLICTS, SOURCES, CHANGED)
def maintenance_jobs(g: Graph) -> DataFrame:
    jobs = mt.assertion_jobs(g.state(), g.entities(), g.sources(), 600, 20000, 15000)
    return jobs.groupBy("job").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT subject AS key FROM state WHERE tx_from BETWEEN 500 AND 700 OR tx_to BETWEEN 500 AND 700", STATE)
def cache_invalidation(g: Graph) -> DataFrame:
    """Users whose cached answers depend on an assertion that changed."""
    s = g.state()
    return mt.affected_cache_keys(s.select(F.col("subject").alias("key"), "id"), sx.changed_between(s, 500, 700))


@query("SELECT 'mem-' || conv_id || '-' || turn AS id, role = 'user' OR role = 'system' AS readable FROM conversations")
def shared_records(g: Graph) -> DataFrame:
    """Which turns a user may read if its own and the system's are open and the others private."""
    m = g.memories()
    r = m.select(F.col("id").alias("claim_id"), F.col("agent_id").alias("created_by"), F.when(F.col("agent_id") == "system", "Public").otherwise("Private").alias("visibility"), F.array().cast("array<string>").alias("shared_with"))
    members = g.spark.createDataFrame([("all", "user"), ("all", "assistant")], "team string, agent string")
    return sh.exchange(r, members, "user").select(F.col("claim_id").alias("id"), (F.col("decision") == "shared").alias("readable"))


@query()
def private_counts_noisy(g: Graph) -> DataFrame:
    return sh.private_counts(g.state(), "obj_text", 5, 1.0, 42)


CASES = f"""cases AS (SELECT 'c' || user_id AS id, 'user-' || user_id AS subject, CASE WHEN user_id % 2 = 0 THEN {V} END AS valid_at FROM (SELECT DISTINCT user_id FROM events WHERE user_id IN (7, 8, 9, 10))),
words AS (SELECT id, unnest(['user', 'user', subject[6:], 'click', 'purchase']) AS w FROM cases),
hits AS (SELECT c.id, s.id AS evidence, s.valid_from, s.valid_to, count(*) AS score FROM cases c JOIN words w ON w.id = c.id JOIN state s ON len(w.w) >= 3 AND w.w IN ('user', s.subject[6:], 'state', s.obj_text) GROUP BY ALL),
taken AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, evidence) <= 3),
gold AS (SELECT c.id, list(s.id) AS gold FROM cases c JOIN state s ON s.subject = c.subject AND s.obj_text IN ('click', 'purchase') GROUP BY c.id),
sets AS (SELECT c.id, c.valid_at, coalesce(g.gold, []) AS gold, list(t.evidence) FILTER (t.evidence IS NOT NULL) AS got, avg((t.valid_from > c.valid_at OR (t.valid_to IS NOT NULL AND t.valid_to <= c.valid_at))::INT) AS stale FROM cases c LEFT JOIN gold g ON g.id = c.id LEFT JOIN taken t ON t.id = c.id GROUP BY ALL)"""


@query("""SELECT 'keyword' AS strategy, count(*) AS cases, round(avg(CASE WHEN len(gold) = 0 THEN 1.0 ELSE len(list_intersect(got, gold)) / len(gold) END), 6) AS recall, round(avg(len(list_intersect(got, gold)) / len(got)), 6) AS precision,
  round(avg(CASE WHEN valid_at IS NULL THEN 1.0 ELSE 1 - stale END), 6) AS temporal FROM sets""", STATE, CASES)
def retrieval_report(g: Graph) -> DataFrame:
    """Keyword retrieval out of all events for four questions, and its metrics."""
    evidence = g.state().select("id", "subject", "predicate", F.col("obj_text").alias("object"), "valid_from", "valid_to", F.col("tx_from").alias("known_from"), F.lit("").alias("text"))
    who = g.raw("events").filter("user_id in (7, 8, 9, 10)").select("user_id").distinct()
    subject, none = F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.array().cast("array<string>")
    cases = who.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("user "), subject, F.lit(" click purchase")).alias("question"), F.when(F.col("user_id") % 2 == 0, F.lit(V)).alias("valid_at"), F.lit(None).cast("long").alias("known_at"), none.alias("tags"), subject.alias("subject"))
    gold = evidence.filter("object in ('click', 'purchase')").groupBy("subject").agg(F.collect_list("id").alias("gold_evidence_ids"))
    cases = cases.join(gold, "subject", "left").drop("subject").withColumns({"gold_evidence_ids": F.coalesce("gold_evidence_ids", none), "required_path_ids": none, "gold_contradiction_ids": none})
    paths = g.spark.createDataFrame([], "id string, evidence_ids array<string>")
    clashes = g.spark.createDataFrame([], "id string, assertion_a string, assertion_b string, contradiction_type string")
    got = el.retrieve(cases, evidence, paths, ["keyword"])
    return el.report(el.scored(cases, evidence, paths, clashes, got)).select("strategy", "cases", "recall", "precision", "temporal")
