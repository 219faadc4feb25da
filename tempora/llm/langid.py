"""Language identification with error-correcting output codes.

Every learned language has a codeword, a row of a Hadamard matrix without its
constant columns, so any two differ in half of the bits. One binary n-gram
classifier for each bit (logistic regression on hashed byte bigrams and trigrams
of the whole text) predicts the codeword. Decoding is loss-weighted: each bit's
loss counts by how well its classifier did on each language in a part of the
sample that it was not fitted on; the nearest codeword wins, and a small lead
over the second nearest flags ambiguity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import columns as C
from tempora.llm.frames import arrow, free_name, saved, trim

FEATURES = 4096
SAMPLE = 1536  # texts that the classifiers are fitted on, at most about, over all languages
MAX_LANGUAGES = 256
AMBIGUOUS = 0.05
SHARPNESS = tuple(2.0 ** (i / 4) for i in range(-8, 25))  # among which scores are calibrated
UNKNOWN = "und"
BATCH_BYTES = 1 << 20  # of text at a time; its n-grams and their places take some forty times that

_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 32


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix) in blocks: L2-normed square roots of hashed bigram and trigram counts of whole texts."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    for a, b in C.pieces(lower, BATCH_BYTES):
        raw, offsets = C.text_bytes(lower.slice(a, b - a))
        raw = _TO_SPACE[raw]
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
        offsets = np.append(0, np.cumsum(keep))[offsets]
        raw = raw[keep].astype(np.uint32)
        two = raw[:-1] << 8 | raw[1:]
        three = two[:-1] << 8 | raw[2:]
        with np.errstate(over="ignore"):
            two = (two * np.uint32(2654435761)) >> np.uint32(21)
            three = ((three ^ (three >> np.uint32(11))) * np.uint32(2246822519)) >> np.uint32(20)
        for x in range(a, b, 512):
            y = min(b, x + 512)
            out = np.zeros((y - x, FEATURES), np.float32)
            for i in range(x, y):
                s, e = offsets[i - a], offsets[i - a + 1]
                if e - s > 1:
                    out[i - x] = np.bincount(two[s : e - 1], minlength=FEATURES)
                if e - s > 2:
                    out[i - x] += np.bincount(three[s : e - 2], minlength=FEATURES)
            np.sqrt(out, out=out)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            yield x, out


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 that pairwise differ in half of the columns (plus or minus one), none of them constant."""
    size = 2
    while size < 2 * n:
        size *= 2
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    rows = h[1 : n + 1]
    rows = rows[:, np.abs(rows.sum(axis=0)) < n] if n > 1 else np.ones((n, 1))
    return rows


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits; each row sums to 1
    sharpness: float

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text to each codeword (logistic loss of the bit's margin)."""
        f = x @ self.weights + self.bias
        return np.einsum("lb,nlb->nl", self.trust, np.logaddexp(0, -self.code[None, :, :] * f[:, None, :]))

    def posteriors(self, d: np.ndarray) -> np.ndarray:
        z = -self.sharpness * (d - d.min(axis=1, keepdims=True))
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases for each column of y (+1, -1) by accelerated gradient descent."""
    n, w, b = len(x), np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    w0, b0, step = w, b, 8.0
    for t in range(rounds):
        mw, mb = w + t / (t + 3) * (w - w0), b + t / (t + 3) * (b - b0)
        g = (-y / (1 + np.exp(np.clip(y * (x @ mw + mb), -30, 30)))).astype(np.float32)
        w0, b0, w, b = w, b, mw - step * (x.T @ g / n + l2 * mw), mb - step * g.mean(axis=0)
    return w, b


def sampled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame | None:
    """(h, lang, text): of each language the texts with the least hashes, a quota or all there are; equal texts count once.

    ``rows`` is (text, lang) without nulls; None if it is empty. A first cut at
    four times the quota, of 16 at least, by the number of different texts keeps
    the ranking small; that it leaves fewer than the quota has a chance under 1e-12.
    """
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(7)))
    texts = saved(rows.select("lang", "h").distinct(), "texts")
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    quota = max(16, sample // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, 4.0 * quota / n)])
    few = texts.filter((F.col("h").cast("double") / 2.0**64 + 0.5) <= share[F.col("lang")])
    least = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= quota).select("h", "lang")
    return rows.join(F.broadcast(least), ["h", "lang"]).dropDuplicates(["h", "lang"]).select("h", "lang", "text")


def learn(labelled: DataFrame, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``labelled``: about ``sample`` texts, as many of each language, chosen by a hash of the text.

    Rows without a language or text don't count; equal texts of a language count
    once. Without any row the model knows no language. More than
    ``MAX_LANGUAGES`` languages raise ValueError.
    """
    trim()
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    chosen = sampled(rows, sample)
    if chosen is None:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.zeros((0, 1)), 1.0)

    def run(batches):
        for batch in batches:
            for a, m in features(batch.column(2)):
                at, col = np.nonzero(m)
                ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(m))))
                values = m[at, col]
                yield pa.record_batch([batch.column(0).slice(a, len(m)), batch.column(1).slice(a, len(m)), pa.array([col[s:e].astype(np.uint16).tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array([values[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["h", "lang", "at", "x"])

    got = sorted(chosen.select("h", "lang", "text").transform(arrow, run, "h long, lang string, at binary, x binary").collect(), key=lambda r: (r["h"] % 5 == 0, r["h"], r["lang"]))
    fitted = sum(r["h"] % 5 != 0 for r in got)  # rows from there on are set aside: parts of x are views, not copies
    x = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    languages = sorted(set(r["lang"] for r in got))
    y = np.array([languages.index(r["lang"]) for r in got])
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((FEATURES, 1), np.float32), np.full(1, 9, np.float32), np.ones((1, 1)), 1.0)
    del got
    part = slice(fitted) if len(set(y[:fitted])) == len(languages) else slice(None)
    w, b = _logistic(x[part], code[y[part]].astype(np.float32))
    right = np.sign(x[fitted:] @ w + b) == code[y[fitted:]]
    trust = np.array([(right[y[fitted:] == i].sum(axis=0) + 1) / ((y[fitted:] == i).sum() + 2) for i in range(len(languages))])
    trust /= trust.sum(axis=1, keepdims=True)
    sharpness = _sharpness(Model(languages, code, w, b, trust, 1.0), x[fitted:], y[fitted:])
    w, b = _logistic(x, code[y].astype(np.float32))
    del x
    trim()  # the driver goes on without the sample
    return Model(languages, code, w, b, trust, sharpness)


def _sharpness(model: Model, x: np.ndarray, y: np.ndarray) -> float:
    """How sharply distances make scores: the value under which rows set aside are likeliest.

    As if one more row had each other answer: a sample without errors is no proof that there are none.
    """
    if not len(y):
        return SHARPNESS[0]
    d, k = model.distances(x), len(model.languages)
    wrong = 1 / (len(y) + 2)
    want = np.full(d.shape, wrong / (k - 1))
    want[np.arange(len(y)), y] = 1 - wrong
    loss = []
    for s in SHARPNESS:
        z = -s * d
        loss.append(float(-(want * (z - np.logaddexp.reduce(z, axis=1, keepdims=True))).sum()))
    return SHARPNESS[int(np.argmin(loss))]


def predict(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1), lang_second and lang_ambiguous, from the whole text alone.

    Null texts and texts without a letter, or without a learned language, are
    ``und`` with score 0 and flagged ambiguous. Ties go to the language that
    sorts first. Equal texts get equal values. New columns whose names are taken
    get an underscore.
    """
    names = {c: free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_second", "lang_ambiguous")}
    key = free_name(docs, "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = (T.StringType(), T.DoubleType(), T.StringType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(names.values(), types, strict=True)]])
    width = len(docs.columns)
    plain = docs.columns.count(text_col) == 1 and isinstance(docs.schema[text_col].dataType, T.StringType)
    at_text = docs.columns.index(text_col) if plain else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            text, known = batch.column(at_text), has_letter(batch.column(at_text))
            n, k = batch.num_rows, len(model.languages)
            best, second, score, lead = np.zeros(n, int), np.zeros(n, int), np.zeros(n), np.zeros(n)
            if k:
                for a, x in features(text):
                    d = model.distances(x)
                    order = np.argsort(d, axis=1, kind="stable")
                    at = np.arange(len(x))
                    s = slice(a, a + len(x))
                    best[s], second[s] = order[:, 0], order[:, min(1, k - 1)]
                    score[s] = model.posteriors(d)[at, order[:, 0]]
                    one, two = d[at, best[s]], d[at, second[s]]
                    lead[s] = (two - one) / np.maximum(two + one, 1e-9) if k > 1 else 1.0
            known &= k > 0
            words = np.array([*model.languages, UNKNOWN], object)
            out = [words[np.where(known, best, k)], np.where(known, score, 0.0), words[np.where(known & (k > 1), second, k)], ~known | (lead < AMBIGUOUS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out[0], pa.string()), pa.array(out[1]), pa.array(out[2], pa.string()), pa.array(out[3])], names=schema.names)

    rows = docs if plain else docs.withColumn(key, F.col(f"`{text_col}`").cast("string"))  # a text goes to the worker once
    return rows.transform(arrow, run, schema)


def op1_language_id(spark, sf_dir):
    """Contract query: learn from two thirds of the documents by id, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = learn(docs.filter(rest != 1), "text", "lang")
    out = predict(docs.select("doc_id", "text"), model, "text")
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is identified: neither ``und`` nor ambiguous; columns are those of ``docs``.

    Null and empty texts, and those without a letter, go; a null label only
    doesn't train. A very long text counts as a whole. Rows that repeat go or stay
    together. Names may clash with the operator's own. An empty table gives an
    empty frame.
    """
    model = learn(docs, text_col, lang_col)
    found = predict(docs, model, text_col)
    new = found.columns[len(docs.columns) :]
    return found.filter(~F.col(f"`{new[3]}`")).select(*[f"`{c}`" for c in docs.columns])
