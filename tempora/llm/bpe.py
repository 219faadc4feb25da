"""Byte-pair token ids of whole columns, without a call per word.

A byte-level BPE splits text by a pattern before merging, and no token of that
pattern crosses from a character that isn't white space to one that is. So text
may be cut before every white-space character that follows another character,
and the ids of the text are those of its cuts. Cuts repeat a lot: each piece of
a column encodes its distinct cuts once, in one call, and copies their ids.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tempora.llm import columns as C

#: The pre-splitting pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The last two UTF-8 bytes of white-space characters beyond ASCII.
_SPACE_ENDS = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *[(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)], (0x81, 0x9F)]
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0x80:] = True
_SPACE_PAIR = np.zeros(65536, bool)
for _a, _b in _SPACE_ENDS:
    _SPACE_PAIR[_a << 8 | _b] = True


class Encoder:
    """Ids by ``tokenizers`` from a JSON file; with the same vocabulary as ranks, plain cuts go the faster way."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        self.plain = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.size[i] = len(token)

    def one(self, text: bytes) -> np.ndarray:
        if self.plain is None:
            return np.array(self.full.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        return self.plain.encode_to_numpy(text.decode())

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in a row, and the n+1 offsets of its values."""
        raw, offsets = C.text_bytes(column)
        ids, at = self._cuts(raw, offsets)
        data = raw.tobytes()
        if any(s in data for s in self.special):  # their strings are tokens of their own
            parts = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if any(s in data[a:b] for s in self.special):
                    parts[i] = np.array(self.full.encode(data[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, at

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(raw), bool)
        safe = _SAFE[raw[:-1]]
        safe[1:] &= ~_SPACE_PAIR[raw[:-2].astype(np.uint16) << 8 | raw[1:-1]]
        cut[1:] = C.IS_SPACE[raw[1:]] & safe
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        hashes = C.span_hashes(raw, starts, ends)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        joins = C.IS_SPACE[raw[a]] & ~C.IS_SPACE[raw[b - 1]] & _SAFE[raw[b - 1]] & ~((b - a > 1) & _SPACE_PAIR[raw[np.maximum(b - 2, 0)].astype(np.uint16) << 8 | raw[b - 1]])
        if self.plain is None:
            joins[:] = False
        pool, start, count = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        used = 0
        together = np.flatnonzero(joins)
        data = raw.tobytes()
        if len(together):
            got = self.plain.encode_to_numpy(b"".join([data[x:y] for x, y in zip(a[together].tolist(), b[together].tolist(), strict=True)]).decode())
            token_ends = np.cumsum(self.size[got])
            cut_ends = np.cumsum(b[together] - a[together])
            to = np.searchsorted(token_ends, cut_ends) + 1
            if not np.array_equal(token_ends[to - 1], cut_ends):
                raise AssertionError("a token crosses a cut")
            start[together] = np.append(0, to[:-1])
            count[together] = np.diff(to, prepend=0)
            pool.append(got)
            used = len(got)
        for i in np.flatnonzero(~joins).tolist():
            got = self.one(data[a[i] : b[i]])
            start[i], count[i] = used, len(got)
            pool.append(got)
            used += len(got)
        pool = np.concatenate(pool)
        n = count[inverse]
        done = np.cumsum(n)
        ids = pool[np.repeat(start[inverse] - (done - n), n) + np.arange(done[-1])]
        first_cut = np.searchsorted(starts, offsets)
        return ids, np.append(0, done)[first_cut]


@lru_cache(2)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(json_path, ranks_path)


def has_text(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.greater(pc.binary_length(column), 0), False).to_numpy(zero_copy_only=False)
