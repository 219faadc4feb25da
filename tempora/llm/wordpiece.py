"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links: where no child fits, the longest
pieces of what was read are popped and reading goes on in the state of the rest.
Each link stores how many pieces it pops, and links are followed beforehand, so
the automaton is one table from state and byte to state and popped pieces. A
word's greedy longest-match pieces are counted in one table step for each byte;
no piece is built. Words of a column step together.

A vocabulary is a list of byte strings. Those that start with the word mark can
only begin a word, others only continue one; a word is read as mark + bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import columns as C
from tempora.llm.frames import arrow, free_name

MARK = b" "
FEW = 4  # words that still step together; fewer go on one by one
BATCH_BYTES = 8 << 20


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of base64 tokens and ranks, in rank order."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """States: 0 the start of a word, 1 the start of a continuation, others the trie's nodes.

    ``step[s, c]`` is the next state, ``pops[s, c]`` the pieces popped on the way
    and ``rest[s]`` the pieces left at a word's end. A byte that no piece can
    begin with counts as a piece of its own (an unknown).
    """

    def __init__(self, vocabulary: list[bytes], mark: bytes = MARK):
        children: list[dict[int, int]] = [{}, {}]
        token, depth = [False, False], [1, 0]  # the mark counts, so a link always leads to less depth
        for piece in vocabulary:
            first = bool(mark) and piece.startswith(mark)
            piece = piece[len(mark) :] if first else piece
            if not piece:
                continue
            s = 0 if first or not mark else 1
            for c in piece:
                t = children[s].get(c)
                if t is None:
                    t = len(children)
                    children[s][c] = t
                    children.append({})
                    token.append(False)
                    depth.append(depth[s] + 1)
                s = t
            token[s] = True
        if not mark:
            children[1] = children[0]
        n = len(children)
        self.step, self.rest = np.ones((n, 256), np.int32), np.zeros(n, np.int32)
        # the continuation's start: an unknown byte is one piece; a word's start: its mark alone is a piece before
        link, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        many = np.ones((n, 256), np.uint16)
        for c, t in children[1].items():
            self.step[1, c], many[1, c] = t, 0
        self.step[0], many[0] = self.step[1], many[1] + 1 if mark else many[1]
        for c, t in children[0].items():
            self.step[0, c], many[0, c] = t, 0
        self.rest[0] = 1 if mark else 0
        order = sorted(range(2, n), key=depth.__getitem__)
        parent = np.zeros(n, np.int64)
        byte = np.zeros(n, np.int64)
        for s in range(n):
            for c, t in children[s].items():
                if s != 1 or mark:
                    parent[t], byte[t] = s, c
        for s in order:
            if token[s]:  # all that was read is one piece
                link[s], popped[s] = 1, 1
            else:  # the parent's pieces, then on from its rest with this byte
                v, c = parent[s], byte[s]
                if v < 2:
                    link[s], popped[s] = self._without(v, c, children)
                else:
                    link[s], popped[s] = self.step[link[v], c], popped[v] + int(many[link[v], c])
            self.step[s], many[s] = self.step[link[s]], many[link[s]] + np.uint16(popped[s])
            for c, t in children[s].items():
                self.step[s, c], many[s, c] = t, 0
            self.rest[s] = popped[s] + self.rest[link[s]]
        self.pops = many.astype(np.uint8 if many.max() < 256 else np.uint32)

    @staticmethod
    def _without(v: int, c: int, children) -> tuple[int, int]:
        """From a start whose child by c is no piece and has none before: c read as a continuation, or unknown."""
        if v == 0 and c in children[1] and children[1] is not children[0]:
            return children[1][c], 1  # the mark alone, then c begins a continuation
        return 1, (2 if v == 0 and children[1] is not children[0] else 1)

    def count(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word."""
        lengths = ends - starts
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        at, sizes = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        step, pops = self.step.ravel(), self.pops.ravel()
        active, i = len(order), 0
        while active and sizes[0] > i:
            if sizes[active - 1] <= i:  # words that have ended
                active = int(np.searchsorted(-sizes, -i, side="left"))
            if active <= FEW:
                break
            k = state[:active].astype(np.int64) * 256 + raw[at[:active] + i]
            total[:active] += pops[k]
            state[:active] = step[k]
            i += 1
        for w in range(active):  # the few longest, from where they stand
            s, n = int(state[w]), 0
            for c in raw[at[w] + i : at[w] + sizes[w]].tobytes():
                k = s * 256 + c
                n += pops.item(k)
                s = step.item(k)
            state[w], total[w] = s, total[w] + n
        out[order] = total + self.rest[state]
        return out


@lru_cache(2)
def _automaton(vocabulary: tuple[bytes, ...], mark: bytes) -> Automaton:
    return Automaton(list(vocabulary), mark)


def greedy(word: bytes, vocabulary: set[bytes], mark: bytes = MARK) -> list[bytes]:
    """The pieces themselves, by trying every length up to the longest piece's: what the automaton's counts are held against."""
    out, text, i = [], mark + word, 0
    longest = max(map(len, vocabulary), default=0)
    upto = lambda i: min(len(text), i + longest) + 1
    if mark:
        j = max((j for j in range(len(mark) + 1, upto(0)) if text[:j] in vocabulary), default=len(mark))
        out, i = [text[:j]], j
    while i < len(text):
        j = max((j for j in range(i + 1, upto(i)) if text[i:j] in vocabulary and not (mark and text[i:j].startswith(mark))), default=i + 1)
        out.append(text[i:j])
        i = j
    return out


def token_counts(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text", mark: bytes = MARK) -> DataFrame:
    """``docs`` with n_words and n_tokens: greedy longest-match pieces of all words of each whole text.

    Words are runs outside ASCII white space. A null or empty text has none. A
    word whose first byte begins no marked piece counts its mark as one piece; a
    byte that no piece begins with is one piece. Equal texts have equal counts;
    taken names get an underscore.
    """
    names = [free_name(docs, c) for c in ("n_words", "n_tokens")]
    key = free_name(docs, "__text")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    shared = docs.sparkSession.sparkContext.broadcast((tuple(vocabulary), mark))  # a vocabulary, not data
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(*shared.value)
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for a, b in C.pieces(batch.column(width), BATCH_BYTES):
                raw, offsets = C.text_bytes(batch.column(width).slice(a, b - a))
                starts, ends, first = C.word_bounds(raw, offsets)
                words[a:b] = np.diff(first)
                tokens[a:b] = np.diff(np.append(0, np.cumsum(automaton.count(raw, starts, ends)))[first])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(words), pa.array(tokens)], names=schema.names)

    return docs.withColumn(key, F.col(f"`{text_col}`").cast("string")).transform(arrow, run, schema)


def op7_token_counts(spark, sf_dir):
    """Words and greedy pieces of every document, by the byte-level vocabulary read as word pieces."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs.select("doc_id", "text"), read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).select("doc_id", "n_words", "n_tokens")
