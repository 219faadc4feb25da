from __future__ import annotations

from pyspark.sql import functions as F

from tempora.sources import ingest as ig


def test_chunks_candidates_directives(spark):
    text = "  first line\n\ncandidate: Ada | works_at | X | valid=2020..2022 | confidence=0.9 | evidence=said so\ncandidate: broken | line\nentity: name=Ada | type=Person | name=Eve\nhé"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    c = ig.line_chunks(d)
    rows = {r.line: r for r in c.collect()}
    for r in rows.values():
        assert text.encode()[r.byte_start : r.byte_end].decode() == r.content
    assert sorted(rows) == [0, 2, 3, 4, 5]
    good, bad = sorted(ig.candidates(c).collect(), key=lambda r: r.error or "")
    assert (good.subject_text, good.valid_from, good.valid_to, good.confidence, good.evidence_text) == ("Ada", 2020, 2022, 0.9, "said so")
    assert bad.error == "malformed" and bad.subject_text is None
    assert [(r.kind, r.fields) for r in ig.directives(c).collect()] == [("entity", {"name": "Ada", "type": "Person"})]


def test_csv_json_titles_secrets(spark):
    d = spark.createDataFrame([(1, "s,p,o,e\na,b,c,said\nx,,z,w\nq,r")], "doc_id long, text string")
    assert [(r.subject, r.evidence) for r in ig.csv_rows(ig.line_chunks(d)).collect()] == [("a", "said")]
    j = spark.createDataFrame([(1, '{"entity": "Ada", "type":"Person"}'), (2, "{}")], "i long, t string")
    assert [(r.entity, r.type) for r in ig.json_entity(j, "i", "t").collect()] == [("Ada", "Person")]
    h = spark.createDataFrame([(1, "<html><TITLE> A\nb </title>"), (2, "none")], "page_id long, html string")
    assert [r.title for r in ig.html_titles(h).collect()] == ["A\nb"]
    s = spark.createDataFrame([("my api_key=abc and sk-ABCDEFGH12345678x",)], "t string")
    assert s.select(ig.redact_secrets(F.col("t")).alias("r")).first().r == "my api_key=[REDACTED] and [REDACTED]"


def test_codec_and_encryption(spark):
    parts = ["a:b", "", "é"]
    enc = spark.createDataFrame([(parts,)], "p array<string>").select(ig.encode_parts(F.col("p")).alias("e")).first().e
    assert ig.decode_parts(enc) == parts
    key, new = "00" * 16, "11" * 16
    d = spark.createDataFrame([("secret",)], "c string")
    turned = ig.rotate_key(ig.encrypt(d, "c", key), "c", key, new)
    assert ig.decrypt(turned, "c", new).first().c == "secret"


def test_evaluation_file(spark, tmp_path):
    f = tmp_path / "d.tsv"
    f.write_text("# comment\ndataset: t\ncase: c1 | who? | Ada | 20200101 |  | a,b | e1 | | \nevidence: e1 | s | p | o | 1 | | 2 | text\n")
    t = ig.read_eval_dataset(spark, str(f))
    c = t["case"].first()
    assert (c.answer, c.valid_at, c.known_at, c.tags, c.gold_evidence_ids, c.required_path_ids) == ("Ada", 20200101, None, ["a", "b"], ["e1"], [])
    assert t["evidence"].first().known_from == 2


def test_synthetic_graphs(spark):
    assert ig.synthetic_social(spark, 10, 40).select("subject").distinct().count() == 10
    assert ig.synthetic_chain(spark, 5).count() == 5
