"""Language, quality, toxicity, token counts, packing: against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import boosting, bpe, langid, packing, quality, toxicity, wordpiece


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# language id


def test_codewords_differ_in_about_half_of_the_bits():
    for n in (2, 3, 4, 7, 12):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= code.shape[1] // 2 - 1 and (np.abs(code.sum(axis=0)) < n).all()


def made_up(lang, rng, n=40):
    syllables = {"a": ["ka", "to", "mi", "ru"], "b": ["sch", "ein", "ver", "ung"], "c": ["eau", "tion", "ment", "que"]}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, made_up(lang := rng.choice("abc"), rng, rng.randint(3, 60)), lang) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(d.filter("doc_id % 3 != 1"), "text", "lang")
    out = langid.predict(d.filter("doc_id % 3 = 1").drop("lang"), model, "text")
    want = {i: x for i, _, x in rows}
    got = rows_of(out, "doc_id", "lang_pred", "lang_score")
    assert sum(want[i] == p for i, p, _ in got) / len(got) > 0.97 and all(0 <= s <= 1 for *_, s in got)


def test_language_of_odd_rows(spark, odd_documents, no_documents):
    out = langid.predict(odd_documents, langid.learn(odd_documents, "text", "lang"), "text")
    assert out.columns[-4:] == ["lang_pred_", "lang_score", "lang_second", "lang_ambiguous"]
    got = {r.doc_id: r for r in out.filter("doc_id is not null").collect()}
    assert [got[i]["lang_pred_"] for i in (2, 3, 4, 7)] == ["und"] * 4 and got[2].lang_score == 0 and got[6]["lang_pred_"] == "fr"
    assert out.count() == odd_documents.count()
    empty = langid.predict(no_documents, langid.learn(no_documents, "text", "lang"), "text")
    assert empty.count() == 0
    alone = langid.learn(odd_documents.filter("lang = 'fr'"), "text", "lang")
    assert alone.languages == ["fr"]
    kept = langid.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and kept.filter("doc_id in (2, 3, 4, 7)").count() == 0


def test_copies_do_not_shrink_a_languages_sample(spark):
    rng = random.Random(8)
    texts = [(made_up(x, rng), x) for x, n in (("a", 3), ("b", 40), ("c", 200)) for _ in range(n)]
    d = spark.createDataFrame([t for t in texts for _ in range(1500 if t[1] == "a" else 20)], "text string, lang string")
    got = langid.sampled(d, 96).collect()  # a quota of 32
    assert Counter(r.lang for r in got) == {"a": 3, "b": 32, "c": 32} and len({(r.h, r.lang) for r in got}) == 67
    hashes = {x: sorted(r.h for r in d.filter(F.col("lang") == x).select(F.xxhash64("text", F.lit(7)).alias("h")).distinct().collect()) for x in "abc"}
    assert all(sorted(r.h for r in got if r.lang == x) == hashes[x][:32] for x in "abc")
    assert langid.learn(d, "text", "lang", 96).languages == ["a", "b", "c"]


# quality


def brute_kneser_ney(texts, order):
    """The model over plain dictionaries: a function from an n-gram to its probability."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = bytes([2] * (order - 1)) + t.encode() + bytes([3])
        grams[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d = [None] + [quality.discounts([sum(c == i for c in grams[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, order + 1)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        near = {x: c for x, c in grams[k].items() if x[:-1] == g[:-1]}
        low = p(g[1:])
        if not near:
            return low
        off = lambda c: d[k][min(c, 3) - 1]
        total = sum(near.values())
        c = near.get(g, 0)
        return ((c - off(c) if c else 0) + sum(off(c) for c in near.values()) * low) / total

    return p


def test_kneser_ney_agrees_with_dictionaries(spark):
    rng = random.Random(3)
    texts = [made_up(rng.choice("ab"), rng, 6) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    for order in (2, 4):
        blocks = quality.write_texts(docs.repartition(3), "doc_id", "text")
        got = {r["__c0"]: r for r in quality.perplexities(blocks, trusted, "doc_id", ["__c0"], order, hold=False).collect()}
        p = brute_kneser_ney(texts[:5], order)
        for i, t in enumerate(texts):
            b = bytes([2] * (order - 1)) + t.encode() + bytes([3])
            want = -sum(math.log2(p(b[j : j + order])) for j in range(len(b) - order + 1))
            assert got[i]["__bits"] == pytest.approx(want, rel=1e-5) and got[i]["__n"] == len(t.encode()) + 1 and got[i]["__good"] == (i < 5)


def test_probabilities_sum_to_one(spark):
    texts = ["abab abba", "baba"]
    p = brute_kneser_ney(texts, 3)
    assert sum(p(b"ab" + bytes([x])) for x in range(256)) == pytest.approx(1)


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    rng = random.Random(4)
    rows = [(i, made_up("a", rng, rng.randint(1, 80)), "a") for i in range(200)] + [(1000 + i, "".join(rng.choice("%$#&*!") for _ in range(60)), "a") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(1000, 0)], "doc_id long, quality int")
    out = {r.doc_id: r.quality_accepted for r in quality.classify(docs, labels).collect()}
    assert not any(out[1000 + i] for i in range(10)) and sum(out[i] for i in range(200)) >= 198
    kept = quality.keep_accepted(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, ok in out.items() if ok) and kept.columns == docs.columns


def test_quality_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = quality.classify(odd_documents, labels)
    assert out.count() == 10 and out.filter("quality_bits is null or quality_bits < 0").count() == 0
    assert quality.classify(odd_documents, labels.limit(0)).filter("not quality_accepted").count() == 0
    assert quality.keep_accepted(no_documents, labels).count() == 0


def test_thresholds_are_quantiles_by_language(spark):
    t = spark.createDataFrame([("a", i / 10, True) for i in range(100)] + [("b", 1.0, True), (None, 2.0, True), ("a", 99.0, False)], "lang string, bits double, good boolean")
    got = {(r.every, r.lang): r.limit for r in quality.thresholds(t, "lang", "bits", "good", 0.5, 0.0, 50).collect()}
    assert set(got) == {(False, "a"), (True, None)} and got[False, "a"] == pytest.approx(4.9)


# toxicity


def test_boosting_learns_and_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:400], y[:400])
    assert ((model.raw(x[400:]) > 0) == (y[400:] > 0)).mean() > 0.95
    curve = boosting.isotonic(model.raw(x[:400]), y[:400])
    z = curve(np.linspace(-5, 5, 50))
    assert (np.diff(z) >= 0).all() and z.min() >= 0 and z.max() <= 1
    assert (boosting.fit(x, np.ones(600)).raw(x) > 0).all() and len(boosting.isotonic(np.zeros(0), np.zeros(0)).x)


def test_isotonic_pools_by_brute_force():
    raw, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    c = boosting.isotonic(raw, y)
    assert len(c.x) == 3 and c.x.tolist() == [0, 2, 4.5]


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(400):
        words = made_up(rng.choice("ab"), rng, rng.randint(5, 60)).split()
        if bad := rng.random() < 0.3:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Scum", "st0p1d", "zorgon"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.filter("doc_id % 4 != 0"))
    out = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [(out[i], y) for i, y in marks if i % 4 == 0]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(1)
    x, y, n = rng.integers(0, 9, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float), rng.integers(1, 5, 200)
    a, b = boosting.fit(x, y, weight=n.astype(float)), boosting.fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    assert np.allclose(a.raw(x), b.raw(x))
    raw = np.arange(200.0)
    c, d = boosting.isotonic(raw, y, n.astype(float)), boosting.isotonic(np.repeat(raw, n), np.repeat(y, n))
    assert np.allclose(c.x, d.x) and np.allclose(c.y, d.y)


def test_toxicity_keeps_the_share_of_classes_in_a_sample(spark):
    rng = random.Random(6)
    rows = [(i, f"{made_up('a', rng, 8)} {'idiot' if i % 5 == 0 else 'ka'}", int(i % 5 == 0 and rng.random() < 0.3)) for i in range(16000)]  # 30 % of a fifth
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r.doc_id: r.toxicity for r in toxicity.score(d, toxicity.learn(d, d.select("doc_id", "toxic"), sample=800)).collect()}
    bad = [out[i] for i in range(0, 16000, 5)]
    assert sum(out.values()) / 16000 == pytest.approx(0.06, abs=0.03) and sum(bad) / 3200 == pytest.approx(0.3, abs=0.1)


def test_toxicity_features():
    names = toxicity.NAMES
    learned = (np.zeros(0, np.uint64), np.zeros(0))
    x = toxicity.features(pa.array(["you IDIOT!! w0rd id1ot", "", None, "fine words here"]), learned)
    at = dict(zip(names, x[0], strict=True))
    assert at["lexicon"] > 0 and at["near_second"] > 0 and at["capital_words"] == 0.25 and at["mixed"] == 0.5 and at["disguised"] > 0 and at["repeats"] > 0
    assert not x[1].any() and not x[2].any()


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    out = toxicity.score(odd_documents, toxicity.learn(odd_documents, labels))
    assert out.count() == 10 and out.filter("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0
    assert toxicity.score(no_documents, toxicity.learn(no_documents, labels)).count() == 0
    assert {r.toxicity for r in toxicity.score(odd_documents, toxicity.learn(odd_documents, labels.limit(0))).collect()} == {0.0}


# token counts


@pytest.mark.parametrize("mark", [b" ", b""])
def test_automaton_counts_greedy_pieces(mark):
    rng = random.Random(7)
    for _ in range(150):
        voc = [(mark if rng.random() < 0.5 else b"") + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        a, have = wordpiece.Automaton(voc, mark), set(voc)
        for _ in range(30):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 70])))
            assert a.count(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] == len(wordpiece.greedy(w, have, mark))


def test_token_counts_of_odd_rows(spark, odd_documents, no_documents):
    voc = [b" the", b" ", b"t", b"h", b"e", b" cat", b"c", b"at"]
    out = wordpiece.token_counts(odd_documents, voc)
    want = {r.doc_id: sum(len(wordpiece.greedy(w, set(voc))) for w in (r.text or "").encode().split()) for r in odd_documents.collect() if r.doc_id}
    assert {r.doc_id: r.n_tokens for r in out.filter("doc_id is not null").collect()} == want
    assert wordpiece.token_counts(no_documents, voc).count() == 0


# packing


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


def test_ids_are_the_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    full, enc, rng = Tokenizer.from_file(tokenizer[0]), bpe.Encoder(*tokenizer), random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", " ", "'s", "'ll", "1", "23", "!", "<|endoftext|>", "日本", "\u0085", "\x1c", "\r\n", "🙂", "​", "\x00"]
    xs = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    ids, at = enc.column(pa.array(xs))
    for x, a, b in zip(xs, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == full.encode(x or "", add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("window", [7, 64])
def test_packing_is_lossless(spark, odd_documents, no_documents, tokenizer, window):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer[0])
    docs = odd_documents.repartition(3)
    p = packing.pack(docs, "doc_id", "text", *tokenizer, window=window)
    rows = p.collect()
    seqs: dict = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for k, v in seqs.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == window or k == len(seqs) - 1
    got = Counter()
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        held = by.pop(r.id, b"") + r.ids
        if r.start + r.length == r.doc_tokens:
            got[r.id, held] += 1
        else:
            by[r.id] = held
    want = Counter((r.doc_id, np.array([*full.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs.collect())
    assert got == want and not by
    assert packing.pack(no_documents, "doc_id", "text", *tokenizer).count() == 0
    whole = packing.sequences(p, window, pad_id=9).collect()
    assert all(len(r.ids) == 4 * window for r in whole)


def test_packing_follows_the_order_of_the_write(spark, tokenizer):
    from tempora.llm import mixing
    from tempora.llm.frames import saved

    d = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', int(id) + 1)").alias("text"), F.lit("x").alias("source"))  # later files are larger
    order = lambda p: [r.id for r in sorted(p.filter("start = 0").select("id", "sequence_id", "offset").collect(), key=lambda r: r[1:])]
    table = saved(d.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id"), "test")
    assert len(table.inputFiles()) == 5 and order(packing.pack(table, "doc_id", "text", *tokenizer, stored=True)) == list(range(200))
    d = d.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).repartition(4)
    want = [r["__id"] for r in sorted(mixing.schedule(mixing.mix(d)).collect(), key=lambda r: (r.position, r["__key"], r.copy))]
    assert order(packing.pack(saved(mixing.mixed_documents(d), "test"), "doc_id", "text", *tokenizer, stored=True)) == want
    names = ["x/part-100000-a-c000.snappy.parquet", "x/part-00002-b-c001.parquet", "x/part-00002-b-c000.parquet", "x/other.parquet"]
    assert sorted(names, key=packing.write_order) == [names[2], names[1], names[0], names[3]]


def test_crc_column_is_zlibs(spark):
    assert spark.range(1).select(F.crc32(F.lit(bytearray(b"abc"))).alias("c")).first().c == zlib.crc32(b"abc")
