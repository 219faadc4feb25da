from __future__ import annotations

import json

import pytest

from tempora.operators import evidence as pk
from tempora.operators import ontology as on
from tempora.operators import sharing as sh
from tempora.sources import exports as ex
from tests.test_graph import frame, row

TEXT = """
entity_types:
  Person:
    properties:
      name: string
  Company:
    properties:
      name: string
predicates:
  CEO_OF:
    subject: Person
    object: Company
    constraints:
      max_active_objects_per_subject: 1
  OWNS:
    subject: Entity
    object: Entity
"""


def test_ontology_checks(spark):
    o = on.read_ontology(TEXT)
    assert o.types["Person"] == {"name": "string"} and o.predicates["CEO_OF"]["max"] == 1
    e = spark.createDataFrame([("p", "Person", {"name": "x"}), ("c", "Organization", {"name": "y"}), ("d", "Organization", {}), ("z", "Alien", None)], "id string, entity_type string, properties map<string,string>")
    a = frame(spark, [row("1", "p", "CEO_OF", entity="c", valid=(0, 5)), row("2", "p", "CEO_OF", entity="d", valid=(4, 9)), row("3", "c", "CEO_OF", entity="d"), row("4", "p", "LIKES", entity="c"), row("5", "p", "OWNS", text="t"), row("6", "gone", "OWNS", entity="c"), row("7", "p", "OWNS", entity="gone"), row("8", "z", "OWNS", entity="c")])
    got = sorted(map(tuple, on.assertion_violations(a, e, o).collect()))
    assert got == [("1", "max-active-objects"), ("2", "max-active-objects"), ("3", "subject-type"), ("4", "unknown-predicate"), ("5", "object-type"), ("6", "unknown-subject"), ("7", "unknown-object")]
    assert sorted(map(tuple, on.entity_violations(e, o).collect())) == [("d", "missing-property"), ("z", "unknown-type")]
    assert on.read_exclusive_pairs(spark, "# x\na | b\n").collect()[0].predicate_b == "b"
    with pytest.raises(ValueError):
        on.read_exclusive_pairs(spark, "a | b | c")


def test_sharing(spark):
    r = spark.createDataFrame(
        [("1", "ann", "Private", ["bob"], "the red plan", 0.9, 1), ("2", "ann", "Private", [], "the red plan", 0.9, 1), ("3", "ann", "Team", [], "a red car", 0.9, 1), ("4", "cid", "Team", [], "red", 0.9, 1), ("5", "cid", "Public", [], "Blue  sky", 0.5, 1), ("6", "ann", "Public", [], "blue sky", 0.7, 1), ("7", "bob", "Private", [], "own", 0.9, 1)],
        "claim_id string, created_by string, visibility string, shared_with array<string>, text string, confidence double, tx_from long",
    )
    m = spark.createDataFrame([("t", "ann"), ("t", "bob")], "team string, agent string")
    assert sorted(x.claim_id for x in sh.readable(r, m, "bob").collect()) == ["1", "3", "5", "6", "7"]
    assert [(x.claim_id, x.score) for x in sh.recommend_sharing(r, m, "bob", ["ann", "cid"], "red car").collect()] == [("3", 1.0)]
    assert sum(x.decision == "denied" for x in sh.exchange(r, m, "bob").collect()) == 2
    assert [x.claim_id for x in sh.accepted(r).collect()] == ["6"]


def test_private_counts(spark):
    d = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "k string")
    got = {r.k: r.n for r in sh.private_counts(d, "k", 5, 2.0, 7).collect()}
    assert set(got) == {"a"} and abs(got["a"] - 6) <= 0.5 and got["a"] != 6
    assert sh.noise(7, "a", 2.0) == sh.noise(7, "a", 2.0) != sh.noise(8, "a", 2.0)


def test_exports(spark, tmp_path):
    e = spark.createDataFrame([("1", "q", "yes", "no", ["e1", "e2"], ["a", "b"]), ("2", "q2", "a", None, ["e"], [])], "id string, question string, answer string, rejected string, evidence array<string>, path array<string>")
    ex.write_lines(ex.supervised(e), f"{tmp_path}/sft")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/sft").collect()]
    assert {x["id"]: x["messages"][1]["content"] for x in lines} == {"1": "yes", "2": "a"}
    pair = [json.loads(r.value) for r in ex.preferences(e).collect()]
    assert len(pair) == 1 and pair[0]["rejected"][0]["content"] == "no"
    assert sorted(map(tuple, ex.path_supervision(e).collect())) == [("1", 0, "a"), ("1", 1, "b")]
    assert ex.retrieval_examples(e).count() == 2
    bad = spark.createDataFrame([("1", "q", None, None, ["e"], [])], e.schema)
    with pytest.raises(Exception, match="incomplete"):
        ex.supervised(bad).collect()


def test_compression_cuts_required_units_and_skips_others(spark):
    u = spark.createDataFrame([("k", "a", "one two three", True, 0.1, 1), ("k", "b", "x " * 9, False, 0.9, 1), ("k", "c", "four five", False, 0.5, 1), ("k", "d", "six seven eight nine", True, 0.05, 1)], "k string, id string, text string, required boolean, score double, level int")
    got = {r.id: r.text for r in pk.compress(u, 6, ["k"]).collect()}
    assert got == {"a": "one two three", "d": "six seven eight"}
