"""WARC archives, media shards, mixing, near duplicates, top-k: round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tempora.llm import media, mixing, neardup, topk, warc
from tempora.llm.frames import new_path

# warc


def pages(spark):
    big, other = "<html>" + "x" * 1200, "<p>" + "yé" * 700
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c\r\nEvil: 1", other), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "n", big), (7, "u", ""), (7, "u", ""), (8, "x", "z" * 3_000_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_archives_round_trip(spark):
    df, rows = pages(spark)
    index = warc.write_archives(df.withColumnRenamed("url", "url"), new_path(spark, "warc"))
    got = warc.read_archives(index.select("archive").distinct()).collect()
    big = [r for r in rows if r[2] and len(r[2].encode()) >= 1000]
    largest = {t: max((r[0] for r in big if r[2] == t and r[0] is not None), default=None) for t in {r[2] for r in big}}
    want = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        top = largest.get(html)
        revisit = len(body) >= 1000 and top is not None and i != top
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    bodies = Counter((r.page_id, bytes(r.payload)) for r in got if r.record_type == "response")
    assert all((i, (h or "").encode()) in bodies for i, _, h in rows if largest.get(h, i) == i)
    for r in index.collect():  # each record alone, by its place
        head, _ = warc.read_record(r.archive, r.offset, r.length)
        assert head["WARC-Type"] in ("response", "revisit") and "Evil" not in head


def test_file_begins_with_a_dictionary_and_plain_tools_read_it(spark):
    df, _ = pages(spark)
    path = warc.write_archives(df, new_path(spark, "warc")).first().archive.replace("file://", "")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert 0 < int.from_bytes(data[4:8], "little") < len(data)


def test_no_pages(spark):
    df, _ = pages(spark)
    index = warc.write_archives(df.limit(0), new_path(spark, "warc"))
    assert index.count() == 0 and warc.read_archives(index.select("archive")).count() == 0


def test_dictionary_of_few_samples():
    assert warc.dictionary([]) and warc.dictionary([b"abc"]) and warc.dictionary([b"same"] * 40)


# media


def test_form_is_lossless_and_features_agree():
    rng = random.Random(0)
    for n in (192, 192 * 7, 192 * 100):
        payload = bytes(rng.randrange(256) for _ in range(n))
        form = media.encode(payload)
        assert media.decode(form) == payload and media.header(form) == (64, n // 192, 8)
        assert media.feature(payload) == media.feature(media.decode(form))


def test_media_columns(spark, odd_documents, no_documents):
    folder = new_path(spark, "media")
    got = media.media_columns(odd_documents, folder, fill=lambda o: media.with_payload_digests(media.with_metadata(o))).collect()

    def payload(t):
        b = (t or "").encode()
        return b + b" " * ((-len(b)) % 192 if b else 192)

    want = Counter((r.doc_id, len((r.text or "").encode()), hashlib.sha256(payload(r.text)).hexdigest(), zlib.crc32(payload(r.text)[-16:])) for r in odd_documents.collect())
    assert Counter((r.id, r.n, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.shard, r.offset) for r in got}) == len({r.digest for r in got})
    for r in got:
        with tarfile.open(r.shard.replace("file://", "")) as tar:
            member = tar.getmember(f"{r.digest}.png")
            assert (member.offset_data, member.size) == (r.offset, r.length) and hashlib.sha256(tar.extractfile(member).read()).hexdigest() == r.media_sha256
        assert r.width * r.height * 3 == r.payload_bytes
    assert media.media_columns(no_documents, folder).count() == 0


# mixing


def water(sizes, weights, most):
    target, left, free = {}, float(sum(sizes.values())), set(sizes)
    while free:
        level = left / sum(weights[s] for s in free)
        full = [s for s in free if most * sizes[s] <= weights[s] * level]
        if not full:
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target | {s: weights[s] * left / sum(weights[x] for x in free) for s in free}


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([1, 5, 50, 1000, 0]) for i in range(rng.randint(1, 12))}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water(sizes, weights, 3)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def mixed_source(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_targets_and_reruns_agree(spark):
    d = mixed_source(spark)
    rows = mixing.mix(d).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["__source"]].append(r)
        assert r.taken <= 3 * r["size"] and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.position <= 1 for c in r.copies)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert 0 <= rs[0].target - sum(r.taken for r in rs) < 1.001
    again = {r["__id"]: (r.taken, r.copies) for r in mixing.mix(d.repartition(5)).collect()}
    assert again == {r["__id"]: (r.taken, r.copies) for r in rows}


def test_positions_invert_the_demand(spark):
    from pyspark.sql import functions as F

    for knots in ([1.5, 1.0, 0.5], [0.0, 2.0], [1.0, 1.0, 1.0], [0.5, 0.0, 0.0, 3.0]):
        df = spark.range(0, 101).select(mixing._position(F.col("id").cast("double"), F.lit(100.0), F.array(*[F.lit(float(k)) for k in knots])).alias("t"))
        t = np.array([r.t for r in df.collect()])
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(t, grid, done / done[-1]) * 100, np.arange(101), atol=0.02) and (np.diff(t) >= 0).all()


def test_mixed_documents_have_the_taken_words(spark):
    d = mixed_source(spark, 1)
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r["__source"]] += r.taken
    got = Counter()
    for r in mixing.mixed_documents(d).collect():
        got[r.source] += len(r.text.split())
    assert got == +want


def test_places_by_brute_force(spark, tmp_path):
    d = mixed_source(spark, 2)
    d = d.union(d.limit(40))  # equal rows
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op3_mixing(spark, str(tmp_path)).collect()
    mixed = mixing.mix(d).collect()
    copies = sorted((c.position, r["__key"], i, r["__id"]) for r in mixed for i, c in enumerate(r.copies))
    want = Counter((x[3], k, x[0]) for k, x in enumerate(copies))
    assert Counter((r.doc_id, k, t) for r in got for k, t in zip(r.places, r.positions, strict=True)) == want
    assert len(got) == len(mixed) and all(len(r.places) == r.copies and r.places == sorted(r.places) for r in got) and any(not r.places for r in got)


def test_mixing_odd_rows(spark, odd_documents, no_documents):
    m = mixing.mix(odd_documents).collect()
    assert len(m) == 10 and {r["size"] for r in m if r["__id"] in (2, 3, 4)} == {0}
    out = mixing.mixed_documents(odd_documents)
    assert out.columns == odd_documents.columns and out.filter("text is null").count() == 0
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0


# near duplicates


def brute_components(rows, k, num, den):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_duplicates_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(neardup, "CHUNK", chunk)  # 4: every larger bucket is dealt out as pairs of chunks
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 4, 9, 40, 300]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            t = [w if rng.random() > rng.choice([0, 0.01, 0.04, 0.1]) else f"w{rng.randrange(400)}" for w in base]
            rows.append((n * 7 % 1009, " ".join(w.upper() if rng.random() < 0.2 else w for w in t)))
            n += 1
    for k, num, den in ((3, 85, 100), (5, 4, 5)):
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, num=num, den=den).collect()
        assert {r.id: (r.n_shingles, r.component) for r in got} == brute_components(rows, k, num, den)


def test_near_duplicates_of_odd_rows(spark, odd_documents, no_documents):
    got = neardup.near_duplicates(odd_documents).collect()
    assert len(got) == 10
    by = defaultdict(set)
    for r in got:
        by[r.id].add((r.component, r.n_shingles > 0, r.kept))
    assert by[1] == {(1, True, True)} and by[None] == {(1, True, False), (None, False, True)} and by[3] == {(3, False, True)}
    kept = neardup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns and kept.filter("doc_id = 1").count() == 1
    assert neardup.near_duplicates(no_documents).count() == 0 and neardup.keep_one(no_documents).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        off = []
        for _ in range(40):
            n = 2000
            a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            b = a.copy()
            k = int(n * (1 - share) / (1 + share))
            b[:k] = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append(neardup.estimate(neardup.sketch(np.unique(a)), n, neardup.sketch(np.unique(b))[None, :], np.array([n]))[0] - truth)
        assert abs(np.mean(off)) < 0.03 and max(map(abs, off)) < 0.2


# top-k


def brute_top(rows, k):
    out = []
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for i, q in good:
        if i % 20 == 0:
            s = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_by_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in (rng.integers(-2, 3, 4) if seed else rng.normal(0, 3, 4))]) for i in range(140)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (220, [1.0, 2.0]), (221, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    got = sorted(map(tuple, topk.exact_top_k(v, v.filter("vec_id % 20 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top(rows, 5)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    assert sorted(map(tuple, topk.exact_top_k(v, v.filter("vec_id = 0"), 5).collect())) == [(0, 1, 1, 64 * 128), (0, 2, 1, 64 * 128)]
    none = v.limit(0)
    assert topk.exact_top_k(none, none, 5).count() == 0
