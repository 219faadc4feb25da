"""Operators on small hand-made graphs with known answers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import scalar as fx
from tempora.operators import aggregates as ax
from tempora.operators import belief as bx
from tempora.operators import contradictions as cx
from tempora.operators import events as ev
from tempora.operators import evidence as pk
from tempora.operators import graph as gx
from tempora.operators import kernel as kx
from tempora.operators import memory as mx
from tempora.operators import select as sx
from tempora.plans import lang
from tempora.sources.graph import ASSERTION


def row(id, subject, predicate, entity=None, text=None, valid=(0, None), tx=(1, None), pct=80, context=None, status="Active", sources=("s1",)):
    return (id, subject, predicate, "Entity" if entity else "Text", entity, text, *valid, *tx, pct, pct / 100, list(sources), context, status)


def frame(spark, rows):
    return spark.createDataFrame(rows, ASSERTION)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_contradiction_types_and_their_order(spark):
    a = frame(
        spark,
        [
            row("r1", "x", "P", text="a", status="Retracted", pct=50), row("r2", "x", "P", text="a", pct=70),  # replaced by the surer one
            row("e1", "y", "ALIVE", text="yes"), row("e2", "y", "DEAD", text="yes"),  # exclusive predicates
            row("s1", "z", "AGE", text="3"), row("s2", "z", "AGE", text="4"), row("s3", "z", "AGE", text="5", context="tenant:1"), row("s4", "z", "AGE", text="6", valid=(5, 5)),
            row("o1", "w", "AT", entity="p"), row("o2", "w", "AT", entity="q"), row("o3", "w", "AT", entity="r", valid=(0, 1), status="Retracted"),
        ],
    )
    exclusive = spark.createDataFrame([("ALIVE", "DEAD")], "predicate_a string, predicate_b string")
    got = {(r.assertion_a, r.assertion_b): (r.type, r.severity) for r in cx.contradictions(a, exclusive).collect()}
    scalar = ("IncompatibleScalarValues", "Medium")
    assert got == {("r2", "r1"): ("LowerConfidenceReplacement", "Low"), ("e1", "e2"): ("MutuallyExclusivePredicates", "Critical"), ("s1", "s2"): scalar, ("s1", "s4"): scalar, ("s2", "s4"): scalar, ("o1", "o2"): ("ExactPredicateConflict", "High")}


@pytest.mark.parametrize("seed", range(3))
def test_binned_join_finds_the_same_pairs(spark, seed):
    r = random.Random(seed)
    rows = [row(f"a{i:03}", f"x{r.randrange(3)}", "P", text=str(r.randrange(3)), valid=(s := r.randrange(50), r.choice([None, s + r.randrange(20)])), status=r.choice(["Active", "Retracted"]), pct=r.randrange(100)) for i in range(80)]
    a = frame(spark, rows)
    key = lambda df: sorted((r.assertion_a, r.assertion_b, r.type) for r in df.collect())
    assert key(cx.contradictions(a)) == key(cx.contradictions(a, bin_width=7, last=80))


def test_most_objects_at_once(spark):
    a = frame(spark, [row("1", "x", "P", text="a", valid=(0, 5)), row("2", "x", "P", text="b", valid=(5, 9)), row("3", "x", "Q", text="a", valid=(0, None)), row("4", "x", "Q", text="b", valid=(3, 4)), row("5", "x", "Q", text="c", valid=(3, 3))])
    assert {(r.predicate, r.most) for r in cx.max_concurrent_objects(a).collect()} == {("P", 1), ("Q", 2)}


def brute_paths(edges, start, depth, allowed=None):
    out, stack = set(), [((start,), ())]
    while stack:
        nodes, hops = stack.pop()
        if len(hops) == depth:
            continue
        for i, s, p, o in edges:
            if s == nodes[-1] and o not in nodes and (allowed is None or p in allowed):
                out.add((*hops, i))
                stack.append(((*nodes, o), (*hops, i)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_agree_with_a_search(spark, seed):
    r = random.Random(seed)
    e = [(f"h{i}", f"n{r.randrange(7)}", r.choice("PQ"), f"n{r.randrange(7)}") for i in range(18)]
    a = frame(spark, [row(i, s, p, entity=o) for i, s, p, o in e])
    start = spark.createDataFrame([("n0",)], "id string")
    for allowed in (None, ["P"]):
        got = {tuple(x.hops) for x in gx.paths(gx.edges(a), start, 3, predicates=allowed, positional=False).collect()}
        assert got == brute_paths(e, "n0", 3, allowed)


def test_paths_go_on_past_the_end_unless_told_otherwise(spark):
    a = frame(spark, [row("1", "a", "P", entity="b"), row("2", "b", "P", entity="c"), row("3", "a", "P", entity="c"), row("4", "c", "P", entity="d")])
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted(tuple(x.hops) for x in gx.paths(gx.edges(a), start, 3, end="c").collect()) == [("1", "2"), ("3",)]
    assert gx.paths(gx.edges(a), start, 0).count() == 0
    assert gx.paths(gx.edges(a), start, 5, predicates=["P"]).count() == 2  # positions cap the depth
    with pytest.raises(ValueError):
        gx.paths(gx.edges(a), start, 9)


def test_closure_has_its_root_on_a_cycle_only(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    root = lambda n: spark.createDataFrame([(n,)], "id string")
    assert {(r.node, r.depth) for r in gx.reachable(e, root("a")).collect()} == {("b", 1), ("c", 2), ("a", 3)}
    assert {r.node for r in gx.reachable(e, root("x")).collect()} == {"y"}
    assert {(r.node, r.depth) for r in gx.bfs(e, root("a"), 1).collect()} == {("a", 0), ("b", 1)}


@pytest.mark.parametrize("seed", range(3))
def test_components_agree_with_union_find(spark, seed):
    r = random.Random(seed)
    e = [(f"{r.randrange(60):02}", f"{r.randrange(60):02}") for _ in range(45)]
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    touched = {x for a, b in e if a != b for x in (a, b)}
    got = {x.node: x.root for x in gx.components(spark.createDataFrame(e, "a string, b string")).collect()}
    assert got == {x: find(x) for x in touched}


def test_components_of_nothing(spark):
    assert gx.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_page_rank_agrees_with_a_plain_loop(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")]
    got = {r.node: r.score for r in gx.personalized_page_rank(spark.createDataFrame(e, "a string, b string"), spark.createDataFrame([("a", 2.0)], "id string, weight double")).collect()}
    rank = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    for _ in range(16):
        new = dict.fromkeys(rank, 0.0)
        new["a"] = 0.15
        for n, v in rank.items():
            to = [y for x, y in e if x == n]
            for y in to or ["a"]:
                new[y] += 0.85 * v / max(1, len(to))
        rank = new
    assert all(math.isclose(got[n], v, abs_tol=1e-9) for n, v in rank.items())


def test_causal_confidences(spark):
    links = spark.createDataFrame([(1, 2, 50), (2, 3, 50), (3, 1, 90)], "cause long, effect long, pct long")
    start = spark.createDataFrame([(1,)], "id long")
    of = lambda rule: {r.path: r.confidence for r in gx.causal_paths(links, start, 5, rule=rule).collect()}
    assert of("product") == {"1>2": 0.5, "1>2>3": 0.25}
    assert of("min") == {"1>2": 0.5, "1>2>3": 0.5}
    up = gx.causal_paths(links, start, 5, reverse=True)
    assert {r.path for r in up.collect()} == {"3>1", "2>3>1"}


def test_belief_as_of_takes_the_state_before_the_first_later_revision(spark):
    atoms = spark.createDataFrame([("a", "Rejected"), ("b", "Accepted")], "atom_id string, belief string")
    rev = spark.createDataFrame([("a", 1, 10, "Candidate", "Accepted"), ("a", 2, 20, "Accepted", "Rejected")], "atom_id string, seq int, known_at long, previous string, next string")
    at = lambda t: {r.atom_id: r.belief for r in bx.belief_at(atoms, rev, t).collect()}
    assert [at(t)["a"] for t in (5, 10, 19, 20)] == ["Candidate", "Accepted", "Accepted", "Rejected"]
    assert at(5)["b"] == "Accepted"


def test_preferred_claim_and_revisions(spark):
    a = frame(spark, [row("c1", "x", "P", text="a", tx=(1, None), pct=50), row("c2", "x", "P", text="b", tx=(2, None), pct=50), row("c3", "x", "P", text="c", tx=(3, None), pct=10)]).withColumn("trust_pct", F.when(F.col("id") == "c3", 10.0).otherwise(50.0))
    assert [r.id for r in bx.preferred_claim(a, 5, 10).collect()] == ["c2"]  # equal score but for recency
    assert [(r.known_at, r.previous, r.next) for r in bx.belief_revisions(a).orderBy("known_at").collect()] == [(1, None, "c1"), (2, "c1", "c2")]


def test_ratings_are_held_after_every_step(spark):
    e = spark.createDataFrame([("s", i, x) for i, x in enumerate([1] * 8 + [-1] * 2)], "source_id string, seq int, rating int")
    assert bx.human_delta(e).first()["delta"] == pytest.approx(0.15)


def test_budget_skips_what_does_not_fit(spark):
    u = spark.createDataFrame([("k", "a", 6, 3), ("k", "b", 5, 2), ("k", "c", 4, 1), ("k", "d", 99, 9)], "k string, id string, tokens int, rank int")
    got = [r.id for r in pk.greedy_budget(u, 10, ["k"], [F.desc("rank")]).collect()]
    assert got == ["a", "c"]  # not b, though a running sum would stop there


def test_greedy_budget_folds_a_hot_key_to_its_end(spark):
    rank = F.col("id")
    tokens = F.when(rank == 0, 7).when(rank <= 100_050, 5).otherwise(1)  # after the first, only the last ones fit
    hot = spark.range(100_060).select(F.lit("a").alias("k"), "id", tokens.alias("tokens"))
    u = hot.union(spark.createDataFrame([(None, 1, 10), (None, 2, 1), ("b", 1, 11), ("c", 1, 4), ("c", 2, None)], "k string, id long, tokens int"))
    got = sorted((r.k or "", r.id, r.tokens) for r in pk.greedy_budget(u, 10, ["k"], [rank]).collect())
    assert got == [("", 1, 10), ("a", 0, 7), ("a", 100_051, 1), ("a", 100_052, 1), ("a", 100_053, 1), ("c", 1, 4)]



def test_pack_pulls_in_the_other_side(spark):
    a = frame(spark, [row("1", "x", "P", text="a", valid=(0, 5)), row("2", "x", "P", text="b", valid=(3, 9), sources=("s2",)), row("3", "y", "P", text="a")])
    e = spark.createDataFrame([("x",), ("y",)], "id string")
    s = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    p = pk.evidence_pack(a.filter("id = '1'"), a, e, s, cx.contradictions(a))
    assert (ids(p.assertions), ids(p.entities), ids(p.sources)) == (["1", "2"], ["x"], ["s1", "s2"])


def test_governance(spark):
    a = frame(spark, [row("1", "x", "P", text="a", context="tenant:1"), row("2", "x", "P", text="a"), row("3", "x", "P", text="a", context="tenant:1", sources=("s1", "bad"))])
    bad = spark.createDataFrame([("bad",)], "id string")
    assert ids(pk.governed(a, "1", bad)) == ["1"]
    assert {r.id: r.decision for r in pk.audit(a, "1", bad).collect()} == {"1": "allowed", "2": "denied-tenant", "3": "denied-source"}


def test_log_operations(spark):
    log = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (4, "j", "c")], "seq long, key string, value string")
    assert {(r.key, r.value) for r in ev.replay_latest(log).collect()} == {("k", "b"), ("j", "c")}
    assert [r.seq for r in ev.gaps(log).collect()] == [4]
    assert ev.parity(ev.snapshot_and_tail(ev.replay_latest(log.filter("seq < 2")), log, 1).select("key", "seq", "value"), ev.replay_latest(log).select("key", "seq", "value"))
    ok = spark.createDataFrame([(1, True), (2, False), (3, True)], "seq long, ok boolean")
    assert [r.seq for r in ev.recover(ok).collect()] == [1]
    tx = ev.sequence(spark.range(50).select(F.col("id").alias("seq"), F.lit("x").alias("kind")), ["seq"], 100)
    assert [(r.seq, r.tx) for r in tx.orderBy("seq").select("seq", "tx").collect()] == [(i, 101 + i) for i in range(50)]
    new = spark.createDataFrame([("i1", "f1"), ("i2", "f2"), ("i3", "zz")], "idempotency_key string, fingerprint string")
    have = spark.createDataFrame([("i2", "f2"), ("i3", "f3")], "idempotency_key string, fingerprint string")
    add, clash = ev.idempotent(new, have)
    assert ([r[0] for r in add.collect()], [r[0] for r in clash.collect()]) == (["i1"], ["i3"])


def test_kernel_conflicts_and_impact(spark):
    atoms = spark.createDataFrame([("atom-a", "Accepted"), ("atom-b", "Candidate"), ("answer-c", "Accepted")], "atom_id string, belief string")
    conflicts = spark.createDataFrame([("c1", ["atom-a", "atom-b"], "Open")], "conflict_id string, atom_ids array<string>, status string")
    out, edges = kx.add_conflicts(atoms, conflicts)
    assert {r.atom_id: r.belief for r in out.collect()} == {"atom-a": "Disputed", "atom-b": "Candidate", "answer-c": "Accepted"}
    assert edges.count() == 4
    deps = spark.createDataFrame([("atom-b", "atom-a"), ("answer-c", "atom-b")], "from_id string, to_id string")
    root = spark.createDataFrame([("atom-a",)], "id string")
    assert {(r.node, r.kind) for r in kx.impact_if_retracted(deps, root).collect()} == {("atom-b", "atom"), ("answer-c", "answer")}


def test_scalars(spark):
    df = spark.createDataFrame([("Hello, World_1!", "2024-05-06"), ("", "17"), ("ÄB c", "soon")], "t string, d string")
    r = df.select(fx.slugify(F.col("t")).alias("s"), fx.parse_timestamp(F.col("d")).alias("ts"), fx.estimate_tokens(F.col("t")).alias("n"), fx.tokens(F.col("t")).alias("w"), fx.extract_between(F.col("t"), "HELLO", "1").alias("b")).collect()
    assert [x.s for x in r] == ["hello-world_1", "unknown", "b-c"]
    assert [x.ts for x in r] == [20240506, 17, None]
    assert [x.n for x in r] == [2, 1, 2]
    assert r[0].w == ["hello", "world", "1"]
    assert r[0].b == ", World_"
    assert fx.fnv1a64(b"a") == "fnv1a64:af63dc4c8601ec8c"


def test_knn_and_percentiles(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [2.0, 0.0])], "id string, embedding array<double>")
    assert [(r.id, r.rank) for r in mx.knn(v, v.filter("id = 'a'"), 3).orderBy("rank").collect()] == [("a", 1), ("d", 2), ("b", 3)]
    p = spark.createDataFrame([("x", float(i)) for i in range(1, 11)], "k string, v double")
    r = ax.percentiles(p, "v", ["k"]).first()
    assert (r.p50, r.p95, r.p99) == (5.0, 10.0, 10.0)


def test_limits():
    assert sx.query_limit(None) == 100
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            sx.query_limit(bad)


def test_language_parses_and_reports_positions():
    s = lang.parse('find Person("Ada") where works_at Company("X") KNOWN_AT "2024-01-02" limit 5 LIMIT 7 WITH EVIDENCE')
    assert (s.verb, s.predicate, s.object.name, s.clauses["KNOWN_AT"], s.clauses["LIMIT"]) == ("FIND", "works_at", "X", 20240102, 7)
    assert lang.plan(s)[-1] == "EvidencePack"
    assert lang.parse('PATH FROM Id("a") TO Id("b") VIA p|q VALID_DURING 1..5').via == ["p", "q"]
    assert lang.parse('COUNTERFACTUAL REMOVE EVENT("e") MAX_DEPTH 2').target == ("EVENT", "e")
    assert lang.cost(lang.parse('CAUSES OF Event("e")')) == 2.0
    for text, at in (("FIND", 4), ("FIND Person(", 12), ("BOGUS x", 0), ("FIND Person LIMIT x", 18), ('PATH FROM Id("a") VALID_DURING 5..1', 35), ("FIND Person )", 12)):
        with pytest.raises(lang.QueryError) as e:
            lang.parse(text)
        assert e.value.position == at, text


def test_parser_never_breaks_otherwise():
    r = random.Random(5)
    parts = ["FIND", "PATH", "FROM", "Id", '("a")', "(", ")", "|", ",", "..", "1", "x", '"', "WHERE", "LIMIT", "é", "VIA", "-5", "2024-01-01"]
    for _ in range(3000):
        try:
            lang.parse(" ".join(r.choice(parts) for _ in range(r.randrange(8))))
        except lang.QueryError:
            pass


def test_language_runs_all_statements(spark):
    a = frame(spark, [row("1", "p", "works_at", entity="c"), row("2", "c", "in", entity="city"), row("3", "p", "works_at", entity="d")])
    e = spark.createDataFrame([("p", "Person", "Ada"), ("c", "Organization", "X"), ("city", "Place", "Rome"), ("d", "Organization", "Y")], "id string, entity_type string, canonical_name string")
    links = spark.createDataFrame([("e1", "e2", 80)], "cause string, effect string, pct long")
    engine = lang.Engine(a, e, links)
    assert ids(engine.run('FIND Person("ada") WHERE works_at Company("x")')) == ["1"]
    assert ids(engine.run("FIND Person WHERE works_at")) == ["1", "3"]  # a bare type filters nothing
    assert [r.hops for r in engine.run('PATH FROM Person("Ada") TO Place("Rome") VIA works_at|in').collect()] == [["1", "2"]]
    assert [r.path for r in engine.run('CAUSES OF Event("e2")').collect()] == ["e1>e2"]
    assert engine.run('CONTRADICTIONS FOR Id("p")').count() == 1
    assert {r.entity for r in engine.run('COUNTERFACTUAL REMOVE ASSERTION("1")').collect()} == {"p", "c"}


def test_a_component_is_walked_once_from_however_many_seeds(spark, monkeypatch):
    levels, walked = gx._levels, []

    def counted(*args):
        out = levels(*args)
        walked.append(out.count())
        return out

    monkeypatch.setattr(gx, "_levels", counted)
    hub = [(f"n{i:03d}", "hub") for i in range(200)]
    other = [("p", "q"), ("q", "r"), ("r", "s"), ("y", "z")]
    pairs = spark.createDataFrame(hub + other, "a string, b string")
    nodes = {x for e in hub for x in e}
    seeds = spark.createDataFrame([(x,) for x in nodes] + [("alone",)], "id string")
    assert sorted(r.node for r in gx.component_of(pairs, seeds).collect()) == sorted(nodes | {"alone"})
    assert walked == [len(nodes) + 1]
    # the hub loses a node to nothing and one to a pair, and joins a chain
    now = hub[2:] + other + [("hub", "s"), ("n001", "new")]
    changed = spark.createDataFrame([(x,) for x in ("hub", "s", "n000", "n001", "new")], "id string")
    after = frame(spark, [row(str(i), a, "P", entity=b) for i, (a, b) in enumerate(now)])
    got = {r.node: r.root for r in gx.recompute_affected(after, gx.components(pairs), changed).collect()}
    joined = (nodes - {"n000", "n001"}) | {"p", "q", "r", "s"}
    assert got == {x: "hub" for x in joined} | {"n001": "n001", "new": "n001", "y": "y", "z": "y"}
    assert walked[1:] == [len(nodes) + 5]  # with p, q, r, s and new


def test_affected_components_and_shortest_paths(spark):
    a = frame(spark, [row("1", "a", "P", entity="b"), row("2", "c", "P", entity="d"), row("3", "x", "P", entity="y")])
    pairs = gx.edges(a).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    roots = gx.components(pairs)
    more = a.union(frame(spark, [row("4", "b", "P", entity="c")]))
    changed = spark.createDataFrame([("b",), ("c",)], "id string")
    got = {r.node: r.root for r in gx.recompute_affected(more, roots, changed).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    start = spark.createDataFrame([("a",)], "id string")
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "z"), ("c", "z")], "a string, b string")
    r = gx.shortest_paths(e, start, "z", 3).first()
    assert (r.nodes, r.length) == (["a", "b", "z"], 2)
    assert gx.shortest_paths(e, start, "q", 3).count() == 0
    rules = spark.createDataFrame([("P", -0.9)], "predicate string, delta double")
    assert gx.confidence_deltas(a.filter("id = '1'"), rules).first().after == 0.0
