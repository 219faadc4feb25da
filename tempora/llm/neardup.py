"""Near-duplicate detection with HyperMinHash sketches, and exact confirmation.

1. Every text becomes its set of k-word shingles (64-bit hashes). Texts with the
   same set form one class; only classes go on, so thousands of copies cost one.
2. A class is sketched by one-permutation hashing into ``REGISTERS`` buckets. A
   register keeps the least hash of its bucket compressed to its leading-zero
   count and ``MANTISSA`` further bits (HyperMinHash); empty buckets borrow from
   others in a fixed order, so that small sets keep full bands.
3. ``BANDS`` bands of registers are the candidate keys. Classes that share a key
   and pass the length bound and the collision-corrected Jaccard estimate are
   candidates. A pair is looked at in the first band it shares only, and nothing
   emits pairs: a bucket yields the members that have a candidate.
4. First each bucket's members are held against its first class only, on full
   sets (integer arithmetic): a cluster of near copies becomes one component at
   a cost in proportion to its members.
5. Pairs of different components remain. In buckets that have several, the full
   sets of members with a candidate meet, and a search over the links that hold
   exactly yields a spanning forest.
6. Components of all links, by alternating stars.

Texts stay in blocks where they are read; their sets are built there again when
asked for. Buckets of more than ``CHUNK`` members, or ``CHUNK_SHINGLES``
shingles, are dealt out as pairs of chunks, of which the largest component's
never meet each other, so no task holds an unbounded bucket and no candidate is
lost.

With 32 bands of 4 registers a pair at similarity 0.85 shares no band with
probability (1 - 0.85^4)^32 < 1e-10, at 0.8 below 1e-7. The estimate is used
for sets of ``ESTIMATE_FROM`` shingles and more, 0.2 under the threshold (over
five standard deviations).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import blocks as B
from tempora.llm import columns as C
from tempora.llm.frames import arrow, discard, join_hot, row_key, saved
from tempora.operators.graph import components

REGISTERS, BANDS, MANTISSA = 128, 32, 10
ROWS = REGISTERS // BANDS
CHUNK, CHUNK_SHINGLES = 512, 4 << 20  # members and shingles of a part of a bucket that one task holds
SPREAD = 1024  # blocks that one copy of a set is sent to
ESTIMATE_FROM, MARGIN = 256, 0.2
BATCH_BYTES = 8 << 20
_U = np.uint64
_SHIFT = _U(64 - 7)
_EDGES = np.arange(REGISTERS, dtype=_U) << _SHIFT
_BUCKET = np.arange(REGISTERS, dtype=_U)


@lru_cache
def _borrow() -> np.ndarray:
    """For each bucket a fixed order of all buckets in which an empty one looks for a value."""
    keys = C._splitmix(REGISTERS * REGISTERS, 77).reshape(REGISTERS, REGISTERS)
    return np.argsort(keys, axis=1)


def compress(least: np.ndarray) -> np.ndarray:
    """uint16 registers of 57-bit bucket minima: 6 bits of leading zeros, then the mantissa bits after the first one."""
    top = np.maximum(least << _U(7), _U(1))
    # the float's exponent could round up on long runs of ones; the high 32 bits suffice for the position
    exact = np.frexp((top >> _U(11)).astype(np.float64))[1]  # 53 bits fit a double exactly
    zeros = np.where(exact > 0, 53 - exact, 53).astype(np.int64)
    body = (top << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
    return ((zeros.astype(_U) << _U(MANTISSA)) | body).astype(np.uint16)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The registers of one sorted non-empty set of 64-bit hashes."""
    at = np.searchsorted(shingles, _EDGES)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((least >> _SHIFT) == _BUCKET)
    registers = compress(least)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _borrow()[empty]
        registers[empty] = registers[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of an (n, REGISTERS) array."""
    r = registers.reshape(len(registers), BANDS, ROWS).astype(_U)
    with np.errstate(over="ignore"):
        z = np.zeros(r.shape[:2], _U)
        for i in range(ROWS):
            z = (z << _U(16)) ^ (z >> _U(48)) ^ r[:, :, i]
        return C.mix64(z + (np.arange(BANDS, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


@lru_cache
def _chance() -> np.ndarray:
    """Chance that registers of two disjoint sets agree, by the log2 of each set's hashes per bucket (0 to 24)."""
    i = np.arange(1, 55)[:, None]
    low = 2.0**-i * (1 + np.arange(2**MANTISSA)[None, :] / 2**MANTISSA)
    high = low + 2.0**-i / 2**MANTISSA
    p = [np.clip(np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-15))), 0, None).ravel() for n in 2.0 ** np.arange(25)]
    return np.array([[float(a @ b) for b in p] for a in p])


def estimate(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
    """Jaccard estimates, corrected for registers that agree by chance."""
    agree = (many == one).mean(axis=1)
    size = lambda n: np.clip(np.log2(np.maximum(n, 1) / REGISTERS), 0, 24).round().astype(int)
    chance = _chance()[size(np.asarray(n_one)), size(np.asarray(n_many))]
    return (agree - chance) / (1 - chance)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, k: int, keep: np.ndarray | None = None):
    """(rows, sets) of a stored batch, some at a time: rows are their indexes in the batch, only those in ``keep``."""
    rows = np.arange(batch.num_rows) if keep is None else np.flatnonzero(keep)
    text = B.column(batch, "__text")
    text = text if keep is None else text.take(pa.array(rows))
    for a, b in C.pieces(text, BATCH_BYTES):
        yield rows[a:b], C.shingle_sets(text.slice(a, b - a), k)


def sketches(blocks: B.Blocks, k: int) -> DataFrame:
    """(block, i, id, n, digest, sig) per row: place, set size, class, registers (null for an empty set)."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("id", blocks.schema["__id"].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(visits):
        for block, uri, _ in visits:
            row = 0
            for batch in B.read(uri):
                for rows, sets in _sets(batch, k):
                    yield pa.record_batch(
                        [pa.array(np.full(len(rows), block)), pa.array((row + rows).astype(np.int32)), B.column(batch, "__id").take(pa.array(rows)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                        names=schema.names,
                    )
                row += batch.num_rows

    return B.visit(blocks, None, run, schema)


def _bands(classes: DataFrame) -> DataFrame:
    """(key, band, d): every class under its candidate keys."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(sig).view(np.int64).ravel()
            yield pa.record_batch([pa.array(keys), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))], names=["key", "band", "d"])

    return classes.select("d", "sig").transform(arrow, run, "key long, band int, d long")


def _groups(batches, width: int):
    """Runs of rows with equal first ``width`` columns out of sorted batches; a run may cross batches."""
    rest = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        k = [t.column(i).to_numpy() for i in range(width)]
        cut = np.zeros(t.num_rows - 1, bool)
        for x in k:
            cut |= x[1:] != x[:-1]
        at = [0, *(np.flatnonzero(cut) + 1).tolist()]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(at[-1])
    if rest is not None:
        yield rest


class _Bucket:
    """One bucket's members: which pairs are candidates here."""

    def __init__(self, t: pa.Table, num: int, den: int):
        self.band, self.num, self.den = t.column("band")[0].as_py(), num, den
        self.component = t.column("c").to_numpy()
        self.cross = t.column("g1")[0].as_py() != t.column("g2")[0].as_py()
        self.chunk = t.column("chunk").to_numpy()
        self.n = t.column("n").to_numpy()
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.keys = band_keys(self.sig)

    def candidates(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that aren't linked with i yet, share this band with it first, and can reach the threshold."""
        others = others[self.component[others] != self.component[i]]
        n, m = self.n[i], self.n[others]
        others = others[self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)]
        if self.cross:
            others = others[self.chunk[others] != self.chunk[i]]
        if len(others):
            others = others[(self.keys[others] == self.keys[i]).argmax(axis=1) == self.band]
        if len(others) and n >= ESTIMATE_FROM:
            m = self.n[others]
            near = estimate(self.sig[i], n, self.sig[others], m) >= self.num / self.den - MARGIN
            others = others[near | (m < ESTIMATE_FROM)]
        return others


def _involved(num: int, den: int):
    def run(batches):
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            bucket, hit = _Bucket(t, num, den), np.zeros(t.num_rows, bool)
            for i in range(t.num_rows - 1):
                c = bucket.candidates(i, np.arange(i + 1, t.num_rows))
                if len(c):
                    hit[i] = hit[c] = True
            if hit.any():
                yield from t.select(["key", "g1", "g2", "chunk", "band", "c", "d", "n", "sig"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return run


def _confirmed(num: int, den: int):
    def run(batches):
        for t in _groups(batches, 3):
            if t.num_rows < 2:
                continue
            bucket, d = _Bucket(t, num, den), t.column("d").to_numpy()
            n = bucket.n
            flat = np.frombuffer(b"".join(t.column("shingles").to_pylist()), _U)
            words, ids = np.unique(flat, return_inverse=True)
            ends = np.cumsum(n)
            mark = np.zeros(len(words), bool)
            members = {c: np.flatnonzero(bucket.component == c) for c in np.unique(bucket.component).tolist()}
            left, a, b = np.arange(t.num_rows), [], []
            while len(left):
                todo = members.pop(int(bucket.component[left[0]])).tolist()  # what is linked already goes on together
                left = left[~np.isin(left, todo)]
                while todo and len(left):
                    i = todo.pop()
                    c = bucket.candidates(i, left)
                    if not len(c):
                        continue
                    own = ids[ends[i] - n[i] : ends[i]]
                    mark[own] = True
                    common = np.array([np.count_nonzero(mark[ids[ends[j] - n[j] : ends[j]]]) for j in c])
                    mark[own] = False
                    linked = c[den * common >= num * (n[i] + n[c] - common)]
                    a += [d[i]] * len(linked)
                    b += d[linked].tolist()
                    for x in np.unique(bucket.component[linked]).tolist():
                        todo += members.pop(x).tolist()
                    left = left[~np.isin(left, todo)]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _full_sets(blocks: B.Blocks, k: int, wanted: DataFrame) -> DataFrame:
    """(d, shingles) of the classes in ``wanted`` (block, i, d), each from one of its texts."""

    def run(visits):
        for _, uri, told in visits:
            of, row = dict(zip(told.column("i").to_pylist(), told.column("d").to_pylist(), strict=True)), 0
            for batch in B.read(uri) if of else ():
                for rows, sets in _sets(batch, k, B.marks(told, row + batch.num_rows)[row:]):
                    yield pa.record_batch([pa.array([of[row + r] for r in rows.tolist()], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["d", "shingles"])
                row += batch.num_rows

    return B.visit(blocks, wanted.select("block", "i", "d"), run, "d long, shingles binary")


def _can_link(num: int, den: int):
    """Of pairs (n, sig, rn, rsig first): those whose sizes and registers allow the threshold."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n, rn = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            one, many = (np.frombuffer(b"".join(batch.column(j).to_pylist()), np.uint16).reshape(-1, REGISTERS) for j in (1, 3))
            keep = den * np.minimum(n, rn) >= num * np.maximum(n, rn)
            keep &= (estimate(one, n, many, rn) >= num / den - MARGIN) | (np.minimum(n, rn) < ESTIMATE_FROM)
            yield pa.RecordBatch.from_arrays(batch.columns[4:], names=batch.schema.names[4:]).filter(pa.array(keep))

    return run


def _stars(blocks: B.Blocks, classes: DataFrame, met: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that hold between the members of a bucket and its first class, confirmed on full sets.

    A cluster of near copies is linked here, at a cost in proportion to its
    members: a member's set is built where its text lies, and the first class's
    set travels there once for each block.
    """
    pairs = saved(met.filter("d != rep").select("d", F.col("rep").alias("first")).distinct(), "star-pairs")
    times = pairs.groupBy("first").agg(F.count("*").alias("times"))
    reps = times.join(classes.select(F.col("d").alias("first"), F.col("n").alias("rn"), F.col("sig").alias("rsig"), F.col("block").alias("rb"), F.col("i").alias("ri")), "first")
    reps = saved(reps, "star-reps")
    both = join_hot(pairs, reps.drop("rb", "ri"), "first", pairs.count()).join(classes.select("d", "n", "sig", "block", "i"), "d")
    both = both.select("n", "sig", "rn", "rsig", "block", "i", "d", "first")
    able = saved(both.transform(arrow, _can_link(num, den), "block long, i int, d long, first long"), "star-able")
    sets = saved(_full_sets(blocks, k, reps.join(able.select("first").distinct(), "first", "left_semi").select(F.col("rb").alias("block"), F.col("ri").alias("i"), F.col("first").alias("d"))), "star-sets")
    want = able.select("block", "first").distinct()
    parts = want.groupBy("first").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    sent = sets.withColumnRenamed("d", "first").join(parts, "first").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sent = want.join(parts, "first").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).drop("parts").join(sent, ["first", "part"])
    null = lambda t: F.lit(None).cast(t)
    told = able.select("block", "i", "d", "first", null("binary").alias("shingles")).union(sent.select("block", null("int"), null("long"), "first", "shingles"))

    def run(visits):
        for _, uri, told in visits:
            whole = told.filter(told.column("shingles").is_valid())
            firsts = dict(zip(whole.column("first").to_pylist(), whole.column("shingles").to_pylist(), strict=True))
            asked: dict = {}
            mine = told.filter(told.column("i").is_valid())
            for i, d, first in zip(*[mine.column(c).to_pylist() for c in ("i", "d", "first")], strict=True):
                asked.setdefault(i, []).append((d, first))
            row, a, b = 0, [], []
            for batch in B.read(uri) if asked else ():
                for rows, sets in _sets(batch, k, B.marks(mine, row + batch.num_rows)[row:]):
                    for r, s in zip(rows.tolist(), sets, strict=True):
                        for d, first in asked[row + r]:
                            other = np.frombuffer(firsts[first], _U)
                            at = np.searchsorted(other, s)
                            common = np.count_nonzero(other[np.minimum(at, len(other) - 1)] == s)
                            if den * common >= num * (len(s) + len(other) - common):
                                a.append(d)
                                b.append(first)
                row += batch.num_rows
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = saved(B.visit(blocks, told, run, "a long, b long"), "star-links")
    discard(pairs, reps, able, sets)
    return links


def _dealt(met: DataFrame) -> DataFrame:
    """Members of buckets (key, band, d, c, n) that hold several components, dealt into groups (key, g1, g2).

    Pairs inside a bucket's largest component D are linked already, so only the
    rest R meets itself and D: chunks of R are paired with all chunks, those of D
    with those of R. A chunk holds about ``CHUNK`` members and ``CHUNK_SHINGLES``
    shingles at most.
    """
    of = met.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    of = of.groupBy("key").agg(F.max_by(F.struct("c", "m", "s"), F.struct("m", "c")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("k")).filter("k > 1")
    parts = lambda m, s: F.greatest(F.ceil(m / CHUNK), F.ceil(s / CHUNK_SHINGLES), F.lit(1)).cast("int")
    top = F.col("top")
    of = of.select("key", top["c"].alias("top"), F.col("m").alias("times"), (parts(F.col("m"), F.col("s")) == 1).alias("whole"), parts(top["m"], top["s"]).alias("dp"), parts(F.col("m") - top["m"], F.col("s") - top["s"]).alias("rp"))
    t = join_hot(met, saved(of, "buckets-of-several"), "key", met.count())
    draw = lambda n: F.pmod(F.xxhash64("d"), n).cast("int")
    is_top = F.col("c") == F.col("top")
    chunk = F.when(F.col("whole"), 0).when(is_top, F.col("rp") + draw(F.col("dp"))).otherwise(draw(F.col("rp")))
    last = F.when(F.col("whole"), 0).when(is_top, F.col("rp") - 1).otherwise(F.col("rp") + F.col("dp") - 1)
    t = t.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return t.select("key", F.least("chunk", "other").alias("g1"), F.greatest("chunk", "other").alias("g2"), "chunk", "band", "c", "d", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num/den or more.

    Returns one row per input row: id, n_shingles, n of its set; component, the
    least id reachable over links, itself included; kept, whether the row's id is
    the component's.

    A null or word-less text has an empty set, links with nothing and is its own
    component. Fewer words than the shingle: the whole sequence is one shingle. A
    very long text has all its shingles in its set, which is built where the text
    lies. Repeated rows share a class and a component. A null id has the
    component of its class; if no member has an id, that is null and kept is
    true. Extra columns are ignored, whatever their names. An empty table gives
    an empty one.
    """
    return _near(_stored(docs, id_col, text_col, []), shingle, num, den).select("id", "n_shingles", "component", "kept")


def _stored(docs: DataFrame, id_col: str, text_col: str, keep: list) -> B.Blocks:
    """Blocks of ids, the columns ``keep`` and texts; narrow: a key of the row's id and text."""
    return B.write(docs.select(F.col(f"`{id_col}`").alias("__id"), *keep, row_key(id_col, text_col).alias("__rk"), F.col(f"`{text_col}`").cast("string").alias("__text")), ["__rk"], "texts")


def _near(blocks: B.Blocks, shingle: int, num: int, den: int) -> DataFrame:
    """(block, i, id, n_shingles, component, kept) of every stored row."""
    rows = saved(sketches(blocks, shingle), "sketches")
    place = F.min(F.struct("block", "i"))
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), place.alias("p"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("times"))
    # d, a number of its own, stands for a class from here on
    classes = saved(classes.select("digest", F.monotonically_increasing_id().alias("d"), "id", "p.block", "p.i", "n", "sig", "times"), "classes")
    bands = _bands(classes)
    buckets = saved(bands.groupBy("key").agg(F.count("*").alias("times"), F.min("d").alias("rep")).filter("times > 1"), "buckets")
    met = saved(join_hot(bands, buckets, "key", classes.count() * BANDS).select("key", "band", "d", "rep"), "met")
    discard(buckets)
    star = _stars(blocks, classes, met, shingle, num, den)
    found = components(star).select(F.col("node").alias("d"), F.col("root").alias("c"))
    labels = classes.select("d", "n").join(found, "d", "left").select("d", F.coalesce("c", "d").alias("c"), "n")
    several = met.join(labels.select("d", "c"), "d").groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("times")).filter("low != high")
    several = saved(several, "several")
    open_ = join_hot(met, several.select("key", "times"), "key", met.count()).select("key", "band", "d")
    open_ = saved(open_.join(labels, "d"), "open-buckets")
    discard(met, several)
    dealt, by = saved(_dealt(open_), "dealt"), ["key", "g1", "g2"]
    discard(open_)
    dealt = dealt.join(classes.select("d", "sig"), "d").select(*dealt.columns, "sig")
    involved = saved(dealt.repartition(*by).sortWithinPartitions(*by).transform(arrow, _involved(num, den), dealt.schema), "candidates")
    wanted = classes.join(involved.select("d").distinct(), "d", "left_semi")
    ready = involved.join(_full_sets(blocks, shingle, wanted), "d").select(*dealt.columns, "shingles")
    links = saved(ready.repartition(*by).sortWithinPartitions(*by).transform(arrow, _confirmed(num, den), "a long, b long"), "links")
    discard(involved)
    roots = components(star.union(links)).select(F.col("node").alias("d"), "root")
    linked = classes.select("digest", "d", "id").join(roots, "d").select("digest", "id", "root")
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    of_class = linked.join(least, "root").select("digest", "component")
    # most classes are one row without a link and need no join
    ids = classes.select("digest", "id", "times").join(of_class, "digest", "left").filter("times > 1 or component is not null")
    ids = saved(ids.select("digest", "times", F.coalesce("component", "id").alias("of_class")), "class-components")
    plain = rows.select("block", "i", "id", "n", "digest")
    out = join_hot(plain, ids.drop("id"), "digest", rows.count(), "left")
    component = F.coalesce("of_class", "id")
    return out.select("block", "i", "id", F.col("n").alias("n_shingles"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def op10_minhash_near_dedup(spark, sf_dir):
    """Contract query: 3-word shingles, similarity 0.85 or more, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = near_duplicates(docs, "doc_id", "text", shingle=3, num=85, den=100)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN least l ON l.node = s.doc_id
"""


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without near duplicates: of each component the row with the least id, whole and once.

    Rows are kept by their place, so rows that repeat a kept id and text stay
    once, whatever the columns are named. Nulls, empty and very long texts, ties
    and empty tables as in :func:`near_duplicates`; columns are those of ``docs``.
    """
    names = [f"__c{i}" if c != text_col else "__text" for i, c in enumerate(docs.columns)]
    blocks = _stored(docs, id_col, text_col, [F.col(f"`{c}`").alias(x) for x, c in zip(names, docs.columns, strict=True) if c != text_col])
    found = saved(_near(blocks, shingle, num, den), "near-duplicates")
    gone, kept = found.filter("not kept").select("block", "i"), found.filter("kept")
    if not kept.groupBy("id").count().filter("count > 1").isEmpty():  # ids repeat: rows equal in id and text stay once
        keyed = kept.select("block", "i").join(blocks.placed.select("block", "i", "__rk"), ["block", "i"])
        first = keyed.groupBy("__rk").agg(F.min(F.struct("block", "i")).alias("p"))
        gone = gone.union(keyed.select("block", "i").join(first.select("p.block", "p.i"), ["block", "i"], "left_anti"))

    def run(visits):
        for _, uri, told in visits:
            row = 0
            for batch in B.read(uri):
                keep = ~B.marks(told, row + batch.num_rows)[row:]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([B.column(batch, x) for x in names], names=names).filter(pa.array(keep))

    out = B.visit(blocks, gone, run, T.StructType([f for x in names for f in blocks.schema.fields if f.name == x]))
    return out.select(*[F.col(x).cast(docs.schema[c].dataType).alias(c) for x, c in zip(names, docs.columns, strict=True)])
