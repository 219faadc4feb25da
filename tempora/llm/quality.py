"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Counts come from every trusted document and stay distributed: n-grams of each
order, the totals of their contexts and the n-grams that the corpus asks for are
tables, sharded by n-gram, and the interpolated probabilities come from joins
between them, order by order. Nothing of the model is broadcast or collected
but four counts of counts for each order.

Texts stay where they are read. A task writes its documents as blocks of at most
about ``blocks.BLOCK_BYTES`` into the shared folder; a block asks for its distinct
n-grams only, and their log probabilities are joined back to it, so what moves
is a block's vocabulary, never a text. A document's perplexity is held against a
quantile of trusted documents that the model was not trained on, in its language.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import blocks as B
from tempora.llm import columns as C
from tempora.llm.frames import arrow, discard, free_name, saved

ORDER = 6  # bytes of an n-gram, at most 7
HELD = 8  # one in so many trusted texts is held out of the counts, for the thresholds
QUANTILE = 0.995  # of held-out trusted documents' bits a byte, by language
SLACK = 0.1  # bits a byte that a document may lie above the quantile
SHORT = 4.0  # a text of n n-grams is allowed SHORT / sqrt(n) bits a byte more, as short texts vary that much
LEAST_TRUSTED = 50  # held-out documents that a language needs for a quantile of its own
GRID = 1000  # steps of one bit a byte in which quantiles are exact
PIECE_BYTES = 2 << 20
ROWS_OUT, PACKED = 1 << 16, 1 << 20  # n-grams of a batch, and of a packed row
SLICES = 4  # parts of the n-grams that are answered one after the other
_START, _END = 2, 3


def _ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of some texts, and the offsets of each text's.

    A text stands behind order - 1 start bytes and before an end byte, so it has
    one n-gram more than bytes.
    """
    size = np.array([len(t) for t in texts]) + order
    ends = np.cumsum(size)
    start, end = bytes([_START]) * (order - 1), bytes([_END])
    padded = np.frombuffer(b"".join([part for t in texts for part in (start, t, end)]), np.uint8)
    codes = np.zeros(len(padded) - order + 1, np.int64)
    for i in range(order):
        codes <<= 8
        codes |= padded[i : len(codes) + i]
    keep = np.ones(len(codes), bool)
    for i in range(1, order):  # windows that would cross into the next text
        keep[ends[:-1] - i] = False
    return codes[keep], np.append(0, np.cumsum(size - order + 1))


def _pieces(batch: pa.RecordBatch, order: int):
    """(first row, end row, codes, offsets) of a batch's texts (column __text), some at a time; null counts as empty."""
    column = B.column(batch, "__text")
    for a, b in C.pieces(column, PIECE_BYTES):
        raw, offsets = C.text_bytes(column.slice(a, b - a))
        data = raw.tobytes()
        yield a, b, *_ngrams([data[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], order)


class Lookup:
    """A hash table from distinct codes to values with open addressing, in arrays."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2.5 * len(codes)).bit_length())
        self.codes, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, values.dtype)
        slots, left = self._slots(codes), np.arange(len(codes))
        while len(left):
            at = slots[left]
            free = self.codes[at] == -1
            self.codes[at[free]] = codes[left[free]]  # of several for one place the last wins
            left = left[self.codes[at] != codes[left]]
            slots[left] = (slots[left] + 1) & (len(self.codes) - 1)
        self.values[slots] = values

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (C.mix64(codes.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Values of codes that are all in the table."""
        slots = self._slots(codes)
        miss = np.flatnonzero(self.codes[slots] != codes)
        while len(miss):
            slots[miss] = (slots[miss] + 1) & (len(self.codes) - 1)
            miss = miss[self.codes[slots[miss]] != codes[miss]]
        return self.values[slots]


def write_texts(docs: DataFrame, id_col: str, text_col: str) -> B.Blocks:
    """Blocks of all columns of ``docs`` as __c0, __c1, ..., and the text as __text, with whether it is one of those held out (__held); narrow: a hash of the id, 0 for null."""
    text = F.col(f"`{text_col}`").cast("string")
    key = F.col(f"`{id_col}`").cast("string")
    keep = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    rows = docs.select(*keep, F.coalesce(F.xxhash64(text, F.lit(5)) % HELD == 0, F.lit(False)).alias("__held"), text.alias("__text"), F.when(key.isNotNull(), F.xxhash64(key)).otherwise(0).alias("__hid"))
    return B.write(rows, ["__hid"])


def trusted_rows(blocks: B.Blocks, trusted: DataFrame, id_col: str) -> DataFrame:
    """(block, i) of the rows whose id is among ``trusted``; a null id never is."""
    ids = trusted.filter(F.col(f"`{id_col}`").isNotNull()).select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("__hid")).distinct()
    return saved(blocks.placed.filter("__hid != 0").join(ids, "__hid", "left_semi").select("block", "i"), "trusted")


def _bytes_apart(x: np.ndarray) -> bytes:
    """First bytes of all values, then second ones and so on: they compress better so."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _bytes_together(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(block: int, g: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row (block, n, keys, values) of sorted n-grams, as differences, and a value for each."""
    pack = zstandard.ZstdCompressor(level=1)
    return pa.record_batch([pa.array([block]), pa.array([len(g)], pa.int32()), pa.array([pack.compress(_bytes_apart(np.diff(g, prepend=0)))], pa.binary()), pa.array([pack.compress(_bytes_apart(values))], pa.binary())], names=["block", "n", "keys", "lps"])


def _unpacked(keys: bytes, values: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return np.cumsum(_bytes_together(unpack.decompress(keys), np.int64)), _bytes_together(unpack.decompress(values), kind)


def _ngram_rows(asked: DataFrame, part: int | None = None) -> DataFrame:
    """(block, g, c) out of packed rows; of ``SLICES`` parts of all n-grams the one asked for."""

    def run(batches):
        for batch in batches:
            for block, keys, counts in zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True):
                g, c = _unpacked(keys, counts, np.int64)
                if part is not None:
                    own = C.mix64(g.astype(np.uint64)) % np.uint64(SLICES) == part
                    g, c = g[own], c[own]
                for x in range(0, len(g), ROWS_OUT):
                    y = min(len(g), x + ROWS_OUT)
                    yield pa.record_batch([pa.array(np.full(y - x, block)), pa.array(g[x:y]), pa.array(c[x:y])], names=["block", "g", "c"])

    return asked.select("block", "keys", "lps").transform(arrow, run, "block long, g long, c long")


def _asked(order: int, hold: bool):
    """Of a block: its distinct n-grams, each with its count in the trusted texts that aren't held out."""

    def merged(parts):
        g, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return g, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(g)).astype(np.int64)

    def asked(block, uri, told):
        row, kept, new, size = 0, (np.zeros(0, np.int64),) * 2, [], 0
        for batch in B.read(uri):
            good = B.marks(told, row + batch.num_rows)[row:]
            if hold:
                good &= ~B.column(batch, "__held").to_numpy(zero_copy_only=False)
            row += batch.num_rows
            for a, b, codes, at in _pieces(batch, order):
                u, counts = np.unique(codes, return_counts=True)
                if not good[a:b].all():
                    own, n = np.unique(codes[np.repeat(good[a:b], np.diff(at))], return_counts=True)
                    counts = np.zeros(len(u), np.int64)
                    counts[np.searchsorted(u, own)] = n
                new.append((u, counts))
                size += len(u)
                if size > PACKED:  # few pieces wait, so a block takes little more memory than its own n-grams
                    kept, new, size = merged([kept, *new]), [], 0
        g, c = merged([kept, *new])
        for x in range(0, len(g), PACKED):
            yield _packed(block, g[x : x + PACKED], c[x : x + PACKED])

    def run(visits):
        for block, uri, told in visits:
            yield from asked(block, uri, told)

    return run


def _answered(answers: DataFrame) -> DataFrame:
    """Rows (block, g, lp) as few rows (block, n, keys, lps): sorted n-grams as differences, byte by byte, and their log probabilities."""

    def run(batches):
        block, g, lp, size = None, [], [], 0
        for batch in batches:
            b = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y == x:
                    continue
                if size and (b[x] != block or size > PACKED):
                    yield _packed(block, np.concatenate(g), np.concatenate(lp))
                    g, lp, size = [], [], 0
                block, size = int(b[x]), size + y - x
                g.append(batch.column(1).slice(x, y - x).to_numpy())
                lp.append(batch.column(2).slice(x, y - x).to_numpy())
        if size:
            yield _packed(block, np.concatenate(g), np.concatenate(lp))

    return answers.sortWithinPartitions("block", "g").transform(arrow, run, "block long, n int, keys binary, lps binary")


def _scored(order: int, names: list[str]):
    """Of a block: its rows with their index, the sum of -log2 probabilities, the number of n-grams, whether they are trusted and whether held out."""

    def scored(block, uri, told):
        blobs = told.filter(told.column("n").is_valid())
        g, lp = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for keys, lps in zip(blobs.column("keys").to_pylist(), blobs.column("lps").to_pylist(), strict=True):
            for held, got in zip((g, lp), _unpacked(keys, lps, np.float32), strict=True):
                held.append(got)
        table, row = Lookup(np.concatenate(g), np.concatenate(lp)), 0
        for batch in B.read(uri):
            n, bits = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b, codes, at in _pieces(batch, order):
                bits[a:b] = -np.add.reduceat(table(codes).astype(np.float64), at[:-1])
                n[a:b] = np.diff(at)
            good, held = B.marks(told, row + batch.num_rows)[row:], B.column(batch, "__held")
            own = [B.column(batch, x) for x in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(batch.num_rows, block)), pa.array(np.arange(row, row + batch.num_rows, dtype=np.int32)), pa.array(bits), pa.array(n), pa.array(good), held], names=[*names, "__block", "__i", "__bits", "__n", "__good", "__held"])
            row += batch.num_rows

    def run(visits):
        for block, uri, told in visits:
            yield from scored(block, uri, told)

    return run


def discounts(counts: list[int]) -> list[float]:
    """The three discounts out of the numbers of n-grams seen once, twice, three and four times.

    Where a number is missing a discount stays within 0 and its count: half of it.
    """
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [min(max(d, 0.01), i) for i, d in enumerate(raw, 1)]


def probabilities(counts: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p): the interpolated modified Kneser-Ney probability of the last byte of each n-gram in ``asked`` (g).

    ``counts`` is (g, c): n-grams of the trusted text and how often they occur.
    The highest order counts occurrences, lower ones the distinct bytes seen
    before an n-gram. A context never seen takes the lower order's probability;
    below single bytes all 256 are alike. Without counts everything is 1/256.
    """
    seen, wanted = {order: counts.filter("c > 0").select("g", "c")}, {order: asked.select("g").distinct()}
    for k in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND((1 << (8 * k)) - 1)
        seen[k] = saved(seen[k + 1].groupBy(suffix.alias("g")).agg(F.count("*").alias("c")), "counts")
        wanted[k] = wanted[k + 1].select(suffix.alias("g")).distinct()
    p = last = None
    for k in range(1, order + 1):
        cc = seen[k].agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts([cc[f"n{i}"] for i in (1, 2, 3, 4)])
        c = F.col("c")
        context = F.shiftright("g", 8)
        of = lambda x: F.count_if(x)
        totals = seen[k].groupBy(context.alias("x")).agg(F.sum("c").alias("total"), (of(c == 1) * d1 + of(c == 2) * d2 + of(c > 2) * d3).alias("held"))
        t = wanted[k].withColumn("x", context).withColumn("s", F.col("g").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(seen[k], "g", "left").join(totals, "x", "left")
        t = t.join(p.select(F.col("g").alias("s"), F.col("p").alias("low")), "s") if p is not None else t.withColumn("low", F.lit(1 / 256))
        own = F.when(c.isNull(), 0.0).otherwise(c - F.when(c == 1, d1).when(c == 2, d2).otherwise(d3))
        p = t.select("g", F.when(F.col("total").isNull(), F.col("low")).otherwise((own + F.col("held") * F.col("low")) / F.col("total")).alias("p"))
        before, p = last, saved(p, "probabilities")
        last = p
        if before is not None:
            discard(before)
    discard(*[t for k, t in seen.items() if k < order])
    return p


def perplexities(blocks: B.Blocks, trusted: DataFrame, id_col: str, names: list[str], order: int = ORDER, hold: bool = True) -> DataFrame:
    """The stored columns ``names`` of every document with __block and __i (its place), __bits (total -log2 probability), __n (n-grams), __good (trusted) and __held.

    ``trusted`` holds ids under ``id_col``; with ``hold`` one in ``HELD`` trusted
    texts doesn't count in the model. A null text counts as empty: it has the one
    n-gram of its end. A null id is never trusted. Repeated rows count each.
    """
    good = trusted_rows(blocks, trusted, id_col)
    asked = saved(B.visit(blocks, good, _asked(order, hold), "block long, n int, keys binary, lps binary"), "ngrams")
    counts = saved(_ngram_rows(asked).groupBy("g").agg(F.sum("c").alias("c")), "ngram-counts")
    p = probabilities(counts, counts, order)
    discard(counts)
    lp, answers = p.select("g", F.log2("p").cast("float").alias("lp")), []
    for part in range(SLICES):  # one after the other, so that only a slice of the rows is in a shuffle at once
        rows = _ngram_rows(asked, part).select("block", "g").join(lp, "g").select("block", "g", "lp")
        answers.append(saved(_answered(rows), "answers"))
    discard(asked, p)
    answers = reduce(DataFrame.union, answers)
    told = answers.select("block", F.lit(None).cast("int").alias("i"), "n", "keys", "lps").union(good.select("block", "i", *[F.lit(None).cast(t) for t in ("int", "binary", "binary")]))
    schema = T.StructType([*[f for x in names for f in blocks.schema.fields if f.name == x], *[T.StructField(n, t) for n, t in (("__block", T.LongType()), ("__i", T.IntegerType()), ("__bits", T.DoubleType()), ("__n", T.LongType()), ("__good", T.BooleanType()), ("__held", T.BooleanType()))]])
    return B.visit(blocks, told, _scored(order, names), schema)


def thresholds(scored: DataFrame, lang: str, bits: str, good: str, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST_TRUSTED) -> DataFrame:
    """(every, lang, limit) in bits a byte: the quantile of the documents marked ``good``, on a fixed grid, plus the slack.

    A language with fewer than ``least`` of them, null among them, takes the row
    without a language, which is the quantile of all.
    """
    t = scored.filter(F.col(good)).select(F.col(lang).alias("lang"), F.ceil(F.col(bits) * GRID).cast("long").alias("bin"))
    one = t.groupBy("lang", "bin").count().filter("lang is not null")
    bins = one.select("lang", "bin", "count", F.lit(False).alias("every")).union(t.groupBy("bin").count().select(F.lit(None).cast("string"), "bin", "count", F.lit(True)))
    own = Window.partitionBy("every", "lang")
    upto = F.sum("count").over(own.orderBy("bin"))
    bins = bins.withColumn("upto", upto).withColumn("n", F.sum("count").over(own))
    limit = F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * quantile), F.col("bin"))) / GRID + slack
    return bins.groupBy("every", "lang").agg(limit.alias("limit"), F.max("n").alias("n")).filter((F.col("n") >= least) | F.col("every")).select("every", "lang", "limit")


def _judged(blocks: B.Blocks, docs: DataFrame, labels: DataFrame, id_col: str, lang_col: str, label_col: str, carry: list[str], order: int, quantile: float, slack: float) -> tuple[DataFrame, Column]:
    """(scored rows with __limit, whether a row is accepted)."""
    stored = lambda c: f"__c{docs.columns.index(c)}"
    trusted = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").alias("__id"))
    names = list(dict.fromkeys([*[stored(c) for c in carry], stored(lang_col)]))
    scored = perplexities(blocks, trusted, "__id", names, order)
    scored = scored.withColumns({"__bits": F.col("__bits") / F.col("__n"), "__short": SHORT / F.sqrt("__n"), "__lang": F.col(stored(lang_col)).cast("string")})
    scored = saved(scored, "quality")
    held = F.col("__good") & F.col("__held")
    if scored.filter(held).isEmpty():  # too few trusted documents to hold any out
        held = F.col("__good")
    limits = saved(thresholds(scored.select("__lang", (F.col("__bits") - F.col("__short")).alias("__bits"), held.alias("__at")), "__lang", "__bits", "__at", quantile, slack), "limits")
    every = limits.filter("every").select("limit").first()  # one number
    every = F.lit(every["limit"] if every else None).cast("double")
    out = scored.join(limits.filter("not every").select(F.col("lang").alias("__l"), F.col("limit").alias("__limit")), F.col("__lang") == F.col("__l"), "left")
    out = out.withColumn("__limit", F.coalesce("__limit", every) + F.col("__short"))
    return out, F.coalesce(F.col("__bits") <= F.col("__limit"), F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", carry: list[str] | None = None, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all but the text, if not given), then quality_bits, quality_limit, quality_accepted under free names.

    The quantile is taken of bits less the allowance for the text's length; a
    document's limit is that, the slack and its own allowance. Trusted are the
    documents that ``labels`` marks 1 (by id; repeated labels: any 1); one in
    ``HELD`` of their texts, by a hash, sets the limits and the others train the
    model (where none falls to the first, all do both). The perplexity of a text
    is 2 to the power of its bits. Accepted is what lies at or under its
    language's limit; without any trusted document all is accepted and the limit
    is null.

    Null and empty texts are scored on their end alone; a very long text is one
    document, read in one piece. A null id is never trusted; a null language
    takes the limit of all. Repeated rows and ties are scored each. Extra columns
    may have any names. An empty table gives an empty frame.
    """
    carry = [c for c in docs.columns if c != text_col] if carry is None else carry
    blocks = write_texts(docs, id_col, text_col)
    out, accepted = _judged(blocks, docs, labels, id_col, lang_col, label_col, carry, order, quantile, slack)
    named = docs.select(*[f"`{c}`" for c in carry])
    new = [free_name(named, c) for c in ("quality_bits", "quality_limit", "quality_accepted")]
    return out.select(*[F.col(f"__c{docs.columns.index(c)}").alias(c) for c in carry], F.col("__bits").alias(new[0]), F.col("__limit").alias(new[1]), accepted.alias(new[2]))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The accepted documents, with the columns of ``docs``: each row by itself, by its place, so equal rows and equal ids don't matter.

    Nulls, empty and very long texts, ties, repeated rows and empty tables as in
    :func:`classify`; columns may have any names.
    """
    blocks = write_texts(docs, id_col, text_col)
    out, accepted = _judged(blocks, docs, labels, id_col, lang_col, label_col, [], order, quantile, slack)
    gone = out.filter(~accepted).select(F.col("__block").alias("block"), F.col("__i").alias("i"))
    names = [f"__c{i}" if c != text_col else "__text" for i, c in enumerate(docs.columns)]

    def run(visits):
        for _, uri, told in visits:
            row = 0
            for batch in B.read(uri):
                keep = ~B.marks(told, row + batch.num_rows)[row:]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays([B.column(batch, x) for x in names], names=names).filter(pa.array(keep))

    kept = B.visit(blocks, gone, run, T.StructType([f for x in names for f in blocks.schema.fields if f.name == x]))
    return kept.select(*[F.col(x).cast(docs.schema[c].dataType).alias(c) if x == "__text" else F.col(x).alias(c) for x, c in zip(names, docs.columns, strict=True)])


def op4_quality_classifier(spark, sf_dir):
    """Perplexity a byte, its limit (quantile, slack and allowance for the length) and the decision for every document; trusted are those labelled of quality 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = classify(docs.select("doc_id", "lang", "text"), labels)
    return out.select("doc_id", "lang", F.pow(F.lit(2.0), "quality_bits").alias("perplexity"), F.pow(F.lit(2.0), "quality_limit").alias("threshold"), F.col("quality_accepted").alias("accepted"))
