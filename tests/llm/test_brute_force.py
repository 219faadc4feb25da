"""Operators and pipeline stages against plain loops, and the cases that every stage must take."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import boosting, langid, neardup, quality, topk, toxicity
from tests.llm.test_text_operators import brute_kneser_ney, made_up


def test_language_decoding_by_loops(spark):
    rng = random.Random(5)
    rows = [(i, made_up(lang := rng.choice("abc"), rng, rng.randint(2, 40)), lang) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(d, "text", "lang")
    got = {r.doc_id: r for r in langid.predict(d, model, "text").collect()}
    for i, text, _ in rows[:60]:
        x = next(iter(langid.features(pa.array([text]))))[1][0]
        far = []
        for lang in range(len(model.languages)):
            total = 0.0
            for bit in range(model.code.shape[1]):
                margin = float(x @ model.weights[:, bit] + model.bias[bit]) * model.code[lang, bit]
                total += model.trust[lang, bit] * math.log1p(math.exp(-margin))
            far.append(total)
        best = min(range(len(far)), key=far.__getitem__)
        odds = [math.exp(-model.sharpness * f) for f in far]
        assert got[i].lang_pred == model.languages[best] and got[i].lang_score == pytest.approx(odds[best] / sum(odds), rel=1e-4)


def test_scores_say_how_sure_they_are():
    """Where rows set aside are decided right every time, the fitted sharpness is high, but not without limit; where they aren't, low."""
    code = langid.codewords(2)
    model = langid.Model(["a", "b"], code, np.eye(1, code.shape[1], dtype=np.float32), np.zeros(code.shape[1], np.float32), np.full(code.shape, 1 / code.shape[1]), 1.0)
    x = np.array([[3.0], [-3.0]] * 20, np.float32)
    y = np.array([int(code[1, 0] > 0), int(code[1, 0] < 0)] * 20)
    sure, unsure = langid._sharpness(model, x, y), langid._sharpness(model, x, np.roll(y, 1) * (np.arange(40) % 4 > 0) + y * (np.arange(40) % 4 == 0))
    assert sure > unsure


def test_toxicity_scores_by_loops(spark):
    rng = random.Random(9)
    rows = [(i, " ".join([made_up("a", rng, 6), rng.choice(["idiot", "ka"])]), int(rng.random() < 0.4)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(d, d.select("doc_id", "toxic"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(d, model).collect()}
    for i, text, _ in rows[:40]:
        x = toxicity.features(pa.array([text]), model.learned)[0]
        raw = model.trees.base
        for f, c, leaf in zip(model.trees.features, model.trees.cuts, model.trees.leaves, strict=True):
            node = 0
            for _ in range(model.trees.depth):
                node = 2 * node + 1 + int(f[node] >= 0 and x[f[node]] > c[node])
            raw += leaf[node - (2**model.trees.depth - 1)]
        xs, ys = model.curve.x.tolist(), model.curve.y.tolist()
        k = sum(v <= raw for v in xs)
        want = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k - 1] + (ys[k] - ys[k - 1]) * (raw - xs[k - 1]) / (xs[k] - xs[k - 1])
        assert got[i] == pytest.approx(min(max(want, 0), 1), abs=1e-9)


def test_words_of_a_fold_are_learned_elsewhere(spark):
    rows = [(i, f"alpha beta gamma zorg{toxicity.folds(pa.array([f'alpha beta gamma {i}']))[0]} {i}", 1) for i in range(60)] + [(100 + i, f"clean words here {i}", 0) for i in range(60)]
    counts = toxicity._word_counts(spark.createDataFrame(rows, "doc_id long, text string, y int").select("text", "y"))
    every = toxicity._learned_words(counts, None, 256, 5)[0]
    for k in range(toxicity.FOLDS):
        own = {r.h for r in counts.filter((F.col("fold") != k) & (F.col("pos") > 0)).select("h").collect()}
        assert {int(np.uint64(h).view(np.int64)) for h in toxicity._learned_words(counts, k, 256, 5)[0]} <= own
    assert len(every)


def test_best_split_by_trying_all():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (80, 2)).astype(float), rng.integers(0, 2, 80).astype(float)
    model = boosting.fit(x, y, trees=1, depth=1, rate=1.0)
    p = y.mean()
    g, h = p - y, np.full(80, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    every = np.ones(80, bool)
    best = max((gain(x[:, j] <= c) + gain(x[:, j] > c) - gain(every), -j, -c) for j in range(2) for c in np.arange(0.5, 5) if 2 <= h[x[:, j] <= c].sum() and 2 <= h[x[:, j] > c].sum())
    assert (model.features[0][0], model.cuts[0][0]) == (-best[1], -best[2])


def test_quality_stage_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, made_up("a", rng, rng.randint(4, 30)), "a") for i in range(60)] + [(100 + i, "".join(rng.choice("%$#&*!") for _ in range(50)), "a") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    held = {r.doc_id for r in docs.filter(F.xxhash64("text", F.lit(5)) % quality.HELD == 0).collect() if r.doc_id < 40}
    p, order = brute_kneser_ney([t for i, t, _ in rows if i < 40 and i not in held], 3), 3
    bits = {}
    for i, t, _ in rows:
        b = bytes([2] * (order - 1)) + t.encode() + bytes([3])
        n = len(b) - order + 1
        bits[i] = (-sum(math.log2(p(b[j : j + order])) for j in range(n)) / n, quality.SHORT / math.sqrt(n))
    set_by = sorted(math.ceil((bits[i][0] - bits[i][1]) * quality.GRID) for i in (held or range(40)))
    limit = set_by[math.ceil(len(set_by) * quality.QUANTILE) - 1] / quality.GRID + quality.SLACK
    want = {i for i, (x, short) in bits.items() if x <= limit + short + 1e-6}
    assert {r.doc_id for r in quality.keep_accepted(docs, labels, order=order).collect()} == want and not any(i >= 100 for i in want)


def test_clashing_names_come_back(spark):
    rng = random.Random(3)
    names = ["__rk", "block", "i", "uri", "__c0", "__hid", "__i", "d", "times", "__id"]
    docs = spark.createDataFrame([(k, made_up("a", rng, 12), "a", "s", *[f"{n}{k}" for n in names]) for k in range(30)], f"doc_id long, text string, lang string, source string, {', '.join(f'`{n}` string' for n in names)}")
    rows = {r.doc_id: r for r in docs.collect()}
    for kept in (quality.keep_accepted(docs, docs.select("doc_id", F.lit(1).alias("quality"))), neardup.keep_one(docs), langid.keep_identified(docs)):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) > 20 and all(r == rows[r.doc_id] for r in got)


def test_a_cluster_of_near_copies_moves_few_rows(spark, monkeypatch):
    """Twice the members, twice the rows, though a bucket holds many chunks."""
    monkeypatch.setattr(neardup, "CHUNK", 16)
    moved = Counter()
    real = neardup.saved

    def counted(df, name):
        out = real(df, name)
        if name in ("dealt", "star-pairs", "star-able"):
            moved[name] += out.count()
        return out

    monkeypatch.setattr(neardup, "saved", counted)
    rng, sizes = random.Random(1), {}
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for n in (150, 300):
        moved.clear()
        rows = [(k, " ".join([f"x{k}", *base])) for k in range(n)]
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.component for r in out} == {0}
        sizes[n] = sum(moved.values())
    assert sizes[300] <= 2.5 * sizes[150]


def test_top_k_ignores_extra_columns_and_null_ids(spark):
    df = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], None), (None, [9.0], "z")], "vec_id long, embedding array<double>, v string")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    assert [tuple(r) for r in topk.exact_top_k(v, v.filter("vec_id % 20 = 0"), 5).collect()] == [(0, 1, 1, 64 * 128)]


def test_odd_rows_and_no_rows_through_every_stage(spark, odd_documents, no_documents, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(1, 1), (None, 1), (6, None), (3, 0)], "doc_id long, quality int")
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            now = p.saved(stage(spark, now, f"{tmp_path}/{name}"), "test")
            assert now.columns == docs.columns
        packed = p.STAGES[-1][1](spark, now, f"{tmp_path}/{name}").collect()
        whole = p.run(spark, f"{tmp_path}/{name}").collect()
        assert Counter(map(tuple, whole)) == Counter(map(tuple, packed)) and (name == "odd") == bool(packed)
        assert sum(r.start + r.length == r.doc_tokens for r in packed) == now.count()
