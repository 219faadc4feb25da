from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import columns as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\té \x0b\x1c日", max_size=30)), max_size=20)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(xs):
    raw, offsets = C.text_bytes(pa.array(xs, pa.string()))
    starts, ends, first = C.word_bounds(raw, offsets)
    got = [[raw[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(x or "") for x in xs]


@settings(max_examples=100, deadline=None)
@given(texts)
def test_hashes_are_equal_exactly_for_equal_lower_cased_words(xs):
    raw, offsets = C.text_bytes(pa.array(xs, pa.string()))
    starts, ends, _ = C.word_bounds(raw, offsets)
    h = C.word_hashes(raw, starts, ends).tolist()
    words = [raw[s:e].tobytes().lower() for s, e in zip(starts, ends, strict=True)]
    assert len(set(zip(h, words, strict=True))) == len(set(h)) == len(set(words))


def test_long_words_and_gaps():
    xs = ["A" * 200_000 + " " * 150_000 + "b", "a" * 200_000, "b"]
    raw, offsets = C.text_bytes(pa.array(xs))
    starts, ends, _ = C.word_bounds(raw, offsets)
    h = C.word_hashes(raw, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_shingle_sets_by_brute_force():
    xs = ["a b c d A B C", "a b", "B A", None, "", " \n", "x y z"]
    sets = C.shingle_sets(pa.array(xs), 3)
    assert [len(s) for s in sets] == [len({tuple("a b c d a b c".split()[i : i + 3]) for i in range(5)}), 1, 1, 0, 0, 0, 1]
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert sets[1].tolist() != sets[2].tolist()


def test_pieces_cover_everything_once():
    col = pa.array(["x" * 10, None, "", "y" * 100, "z"] * 3)
    at = [p for p in C.pieces(col, 20)]
    assert at[0][0] == 0 and at[-1][1] == len(col) and all(a[1] == b[0] for a, b in zip(at[:-1], at[1:], strict=True))
