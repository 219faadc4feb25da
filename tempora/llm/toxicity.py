"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of the whole text: densities of a fixed lexicon and of words learned
from the labelled sample, how close second-person words stand to lexicon words,
shares of capitals, punctuation and repeated marks, and signs of obfuscation
(words that mix letters with digits or symbols, lexicon words that appear only
after look-alike characters are read as letters).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import boosting
from tempora.llm import columns as C
from tempora.llm.frames import arrow, free_name, saved

SAMPLE = 4096  # labelled documents of each class that the model is fitted on, at most about
LEARNED_WORDS = 256
LEARNED_LEAST = 5  # documents that a learned word must occur in
FOLDS = 4  # parts of the sample, each scored by models of the others for the calibration
NEAR = 5  # words within which a second-person word counts as near
BATCH_BYTES = 4 << 20

#: Insults, and words of address.
LEXICON = (
    "idiot idiots stupid moron morons clown loser losers scum trash worthless pathetic disgusting dumb fool imbecile jerk garbage vermin filth "
    "ugly hate freak creep coward liar disgrace useless crap bastard bitch asshole shit fuck fucking damn whore slut retard kill die "
    "idiota estupido imbécil basura asco maldito tonto inútil abruti débile ordure crétin connard salaud merde dégoutant nul minable "
    "dummkopf trottel arschloch scheisse abschaum versager widerlich wertlos"
).split()
SECOND_PERSON = "you your yours yourself u ur tu te ti tú usted ustedes vos su toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen".split()
#: Characters read as the letters that they look like.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}

NAMES = ["lexicon", "learned", "learned_weight", "hits", "near_second", "second", "capitals", "capital_words", "marks", "exclaims", "repeats", "mixed", "disguised", "symbols", "digits", "log_words"]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _MARK | C.IS_SPACE)
_READ = np.arange(256, dtype=np.uint8)
for _a, _b in LOOK_ALIKE.items():
    _READ[ord(_a)] = ord(_b)
_NOT_LETTER_TO_SPACE = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def word_ids(words) -> np.ndarray:
    """Sorted hashes of lower-case words."""
    raw, offsets = C.text_bytes(pa.array(list(words), pa.string()))
    return np.unique(C.word_hashes(raw, offsets[:-1], offsets[1:])) if len(raw) else np.zeros(0, np.uint64)


def _sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[offsets])


def letter_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters, and the n+1 indexes of each text's first."""
    plain = _NOT_LETTER_TO_SPACE[raw]
    starts, ends, first = C.word_bounds(plain, offsets)
    return C.word_hashes(plain, starts, ends), first


def _is_in(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(hashes), bool)
    return table[np.minimum(np.searchsorted(table, hashes), len(table) - 1)] == hashes


def features(column: pa.Array, learned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of ``NAMES`` for each text; a null or empty text has zeros."""
    lexicon, second = word_ids(LEXICON), word_ids(SECOND_PERSON)
    out = np.zeros((len(column), len(NAMES)))
    for a, b in C.pieces(column, BATCH_BYTES):
        raw, offsets = C.text_bytes(column.slice(a, b - a))
        n = np.maximum(np.diff(offsets), 1)
        h, first = letter_words(raw, offsets)
        words = np.maximum(np.diff(first), 1)
        hit, you = _is_in(h, lexicon), _is_in(h, second)
        known, weights = learned
        new = _is_in(h, known)
        weight = np.zeros(len(h))
        if new.any():
            weight[new] = weights[np.searchsorted(known, h[new])]
        bad = hit | new
        doc = np.repeat(np.arange(b - a), np.diff(first))
        bad_at, you_at = np.flatnonzero(bad), np.flatnonzero(you)
        near = np.zeros(b - a)
        if len(bad_at) and len(you_at):
            right = np.searchsorted(you_at, bad_at)
            for side in (np.minimum(right, len(you_at) - 1), np.maximum(right - 1, 0)):
                close = (np.abs(you_at[side] - bad_at) <= NEAR) & (doc[you_at[side]] == doc[bad_at])
                near += np.bincount(doc[bad_at[close]], minlength=b - a)
        starts, ends, first_token = C.word_bounds(raw, offsets)
        tokens = np.maximum(np.diff(first_token), 1)
        letters, digits, symbols = _LETTER[raw], _DIGIT[raw], _SYMBOL[raw]
        inner = np.zeros(len(raw), bool)  # a digit or symbol between letters
        if len(raw) > 2:
            inner[1:-1] = (digits | symbols)[1:-1] & letters[:-2] & letters[2:]
        mixed = np.zeros(len(starts), bool)
        if inner.any():
            mixed[np.searchsorted(starts, np.flatnonzero(inner), side="right") - 1] = True
        follows = np.zeros(len(raw), bool)  # a look-alike is read as a letter where a letter or digit comes next
        follows[:-1] = (letters | digits)[1:]
        read = np.where(follows, _READ[raw], raw)
        hr, first_read = letter_words(read, offsets)
        disguised = np.maximum(_sum(_is_in(hr, lexicon) | _is_in(hr, known), first_read) - _sum(bad, first), 0)
        upper = _UPPER[raw]
        shouted = np.zeros(len(starts), bool)
        if len(starts):
            size = ends - starts
            ups = np.append(0, np.cumsum(upper))
            let = np.append(0, np.cumsum(letters))
            shouted = (ups[ends] - ups[starts] == let[ends] - let[starts]) & (ups[ends] - ups[starts] > 1) & (size > 1)
        marks = _MARK[raw] | symbols
        again = np.zeros(len(raw), bool)
        again[1:] = marks[1:] & (raw[1:] == raw[:-1])
        edge = offsets[1:-1]
        again[edge[edge < len(raw)]] = False
        out[a:b] = np.stack(
            [
                _sum(hit, first) / words, _sum(new, first) / words, np.diff(np.append(0, np.cumsum(weight))[first]) / words, np.minimum(_sum(bad, first), 50), near / words, _sum(you, first) / words,
                _sum(upper, offsets) / np.maximum(_sum(letters, offsets), 1), _sum(shouted, first_token) / tokens, _sum(marks, offsets) / n, _sum(raw == 33, offsets) / n, _sum(again, offsets) / n, _sum(mixed, first_token) / tokens,
                disguised / words, _sum(symbols, offsets) / n, _sum(digits, offsets) / n, np.log1p(np.diff(first_token)),
            ],
            axis=1,
        )
    return out


@dataclass
class Model:
    learned: tuple[np.ndarray, np.ndarray]
    trees: boosting.Trees
    curve: boosting.Isotonic

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.clip(self.curve(self.trees.raw(features(column, self.learned))), 0, 1)


def folds(column: pa.Array) -> np.ndarray:
    """The fold of each text by its least hash of three words in a row, so that copies, and most near copies, fall into one fold."""
    return np.array([int(s[0] % np.uint64(FOLDS)) if len(s) else 0 for s in C.shingle_sets(column, 3)], np.int32)


def _word_counts(sample: DataFrame) -> DataFrame:
    """(h, fold, pos, neg): in how many texts of each label and fold of the sample (text, y) a word occurs; h 0 counts the texts."""

    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, b in C.pieces(batch.column(0), BATCH_BYTES):
                raw, offsets = C.text_bytes(batch.column(0).slice(a, b - a))
                h, first = letter_words(raw, offsets)
                sets = [np.append(np.unique(h[s:e]), np.uint64(0)) for s, e in zip(first[:-1], first[1:], strict=True)]
                size = [len(s) for s in sets]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch([pa.array(flat.view(np.int64)), pa.array(np.repeat(folds(batch.column(0).slice(a, b - a)), size)), pa.array(np.repeat(y[a:b], size).astype(np.int32))], names=["h", "fold", "y"])

    words = sample.select("text", "y").transform(arrow, run, "h long, fold int, y int")
    return saved(words.groupBy("h", "fold").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "word-counts")


def _learned_words(counts: DataFrame, without: int | None, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that mark label 1 best in the folds but one: hashes in order, and log odds."""
    counts = counts if without is None else counts.filter(F.col("fold") != without)
    size = counts.filter("h = 0").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    pos, neg = size["pos"] or 0, size["neg"] or 0
    if not pos or not neg:
        return np.zeros(0, np.uint64), np.zeros(0)
    words = counts.filter("h != 0").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    got = words.filter(F.col("pos") >= least).withColumn("odds", odds).filter("odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "h").limit(most).collect()
    got = sorted((int(np.int64(r["h"]).view(np.uint64)), r["odds"]) for r in got)
    return np.array([x for x, _ in got], np.uint64), np.array([x for _, x in got], float)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample: about ``sample`` documents of each class, chosen by a hash of the id.

    Rows of a class weigh its labels by its sampled ones, so trees and curve keep
    the share of each class whatever the sample; weights average 1.

    ``labels`` holds the id and a 0/1 label; nulls don't count and of repeated
    labels the highest holds. Documents without a label don't count; equal rows
    count once. Without rows of both classes every score is the share of label 1
    (0 if there is no label).
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    size = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, min(1.0, sample / max(1, size.get(1, 0)))).otherwise(min(1.0, sample / max(1, size.get(0, 0))))
    h = F.xxhash64("id", F.lit(11))
    chosen = marks.withColumn("h", h).filter((F.col("h").cast("double") / 2.0**64 + 0.5) < share).orderBy("h").limit(4 * sample)
    drawn = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = saved(rows.join(F.broadcast(chosen), "id").select("h", "y", "text").dropDuplicates(["h", "text"]), "labelled")
    counts = _word_counts(rows)
    # words, trees and scores of a fold's texts come from the other folds only; the last is the model of all
    learned = [_learned_words(counts, k, LEARNED_WORDS, LEARNED_LEAST) for k in (*range(FOLDS), None)]
    shared = spark.sparkContext.broadcast(learned)

    def run(batches):
        for batch in batches:
            fold = np.zeros(batch.num_rows, np.int32)
            for a, b in C.pieces(batch.column(2), BATCH_BYTES):
                fold[a:b] = folds(batch.column(2).slice(a, b - a))
            x = np.stack([features(batch.column(2), words) for words in shared.value], axis=1).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fold), pa.array(list(x), pa.list_(pa.float64()))], names=["h", "y", "fold", "x"])

    got = sorted((r["h"], r["y"], r["fold"], r["x"]) for r in rows.select("h", "y", "text").transform(arrow, run, "h long, y int, fold int, x array<double>").collect())
    x = np.array([r[3] for r in got]).reshape(len(got), FOLDS + 1, len(NAMES))
    y = np.array([r[1] for r in got], float)
    fold = np.array([r[2] for r in got])
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(learned[-1], boosting.Trees(), boosting.Isotonic(np.array([0.0, 1.0]), np.array([p, p])))
    weight = np.where(y == 1, size[1] / drawn[1], size[0] / drawn[0])
    weight /= weight.mean()
    raw = np.zeros(len(y))
    for k in range(FOLDS):  # scores of rows by models that haven't seen them, words included
        raw[fold == k] = boosting.fit(x[fold != k, k], y[fold != k], weight=weight[fold != k]).raw(x[fold == k, k])
    return Model(learned[-1], boosting.fit(x[:, -1], y, weight=weight), boosting.isotonic(raw, y, weight))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with toxicity (0 to 1) of each whole text; a null or empty text is scored on zeros.

    Equal texts get equal scores. A taken name gets an underscore.
    """
    name, key = free_name(docs, "toxicity"), free_name(docs, "__text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(shared.value.scores(batch.column(width)))], names=schema.names)

    return docs.withColumn(key, F.col(f"`{text_col}`").cast("string")).transform(arrow, run, schema)


def op8_toxicity(spark, sf_dir):
    """Contract query: learn from four fifths of the labels by id, score all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = learn(docs.select("doc_id", "text"), labels.filter(rest != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
