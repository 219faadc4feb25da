"""Vectorised text primitives over Arrow string columns.

Everything here works on one Arrow batch at a time with numpy and holds a
bounded amount of memory per batch; nothing depends on Spark.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` (the ASCII
white space), the same as the pattern ``[^\\x20\\x09-\\x0D]+`` over characters,
because no UTF-8 multi-byte sequence contains those bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPAN = 1 << 20  # bytes hashed at a time; keeps temporaries in cache
_LONG_WORD = 1 << 16


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def mix64(z: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return z ^ (z >> _U(33))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_BYTE = _splitmix(256, 17)
_BYTE_LOWER = _BYTE[ASCII_LOWER]
_BYTE_LOWER_OR_ZERO = np.where(IS_SPACE, _U(0), _BYTE_LOWER)
_BYTE_OR_ZERO = np.where(IS_SPACE, _U(0), _BYTE)
_POWER = _splitmix(_LONG_WORD + 1, 9241) | _U(1)
_SHINGLE = _splitmix(64, 40503) | _U(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 indexes of each value's first word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased first unless told otherwise)."""
    return _hashes(raw, starts, ends, _BYTE_LOWER_OR_ZERO if lower else _BYTE_OR_ZERO, lower)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; the spans lie side by side."""
    return _hashes(raw, starts, ends, _BYTE, False)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, lower: bool) -> np.ndarray:
    """``table`` must be 0 for the bytes between the end of one span and the start of the next."""
    out = np.empty(len(starts), _U)
    lengths = ends - starts
    long_words = np.flatnonzero(lengths > _LONG_WORD)
    i = 0
    stops = iter([*long_words.tolist(), len(starts)])
    stop = next(stops)
    with np.errstate(over="ignore"):
        while i < len(starts):
            if i == stop:  # a word too long for the table of powers
                word = raw[starts[i] : ends[i]]
                word = (ASCII_LOWER[word] if lower else word).tobytes()
                out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                i, stop = i + 1, next(stops)
                continue
            j = max(i + 1, min(stop, int(np.searchsorted(starts, starts[i] + _SPAN))))
            first, s = starts[i], starts[i:j] - starts[i]
            span = raw[first : ends[j - 1]]
            at = np.arange(len(span)) - np.repeat(s, np.diff(np.append(s, len(span))))
            np.minimum(at, _LONG_WORD, out=at)  # only separators after a word can lie further
            out[i:j] = np.add.reduceat(table[span] * _POWER[at], s)
            i = j
        return mix64(out + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each value the sorted distinct 64-bit hashes of its k-word shingles over A-Z lower-cased words.

    Fewer than k words: the whole sequence is the one shingle. No words or null: empty.
    """
    raw, offsets = text_bytes(column)
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        sums = np.zeros(max(0, len(words) - k + 1), _U)
        for j in range(k):
            sums += words[j : j + len(sums)] * _SHINGLE[j]
        sums = mix64(sums)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(sums[a : b - k + 1]))
            elif b > a:
                whole = np.sum(words[a:b] * _SHINGLE[: b - a], dtype=_U) + _U(b - a)
                out.append(mix64(np.array([whole], _U)))
            else:
                out.append(np.zeros(0, _U))
    return out


def pieces(column: pa.Array, limit: int):
    """Slices of a column of at most about ``limit`` bytes each; one value is never split."""
    raw_sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(raw_sizes)
    a = 0
    while a < len(column):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield a, b
        a = b
