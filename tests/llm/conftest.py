from __future__ import annotations

import pytest

pytest.importorskip("tempora.llm.columns")

LONG = "word" * 50_000  # one word of 200,000 bytes


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names clash with operators' own."""
    rows = [
        (1, "the cat sat on the mat and ran away from the dog in the park", "en", "a", 1, "x", 7),
        (1, "the cat sat on the mat and ran away from the dog in the park", "en", "a", 1, "x", 7),
        (2, None, None, None, None, None, None),
        (None, "the cat sat on the mat and ran away from the dog in the park", "en", None, 5, "y", 8),
        (3, "", "fr", "b", 0, "z", 9),
        (4, " \n\t ", "fr", "b", 0, "z", 9),
        (5, LONG, "fr", "b", 0, "z", 9),
        (6, "le chat est dans la maison et le chien est dehors " * 300, "fr", "b", 0, "z", 9),
        (None, None, "de", "c", 0, "z", 9),
        (7, "12345 !!! 678", "de", "c", 0, "z", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `size` long, `lang_pred` string, `__k` long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
