from __future__ import annotations

import os

import pytest

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_stages_fit_together(spark):
    """Every stage takes what the one before kept, and the last packs exactly the mixed documents."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, DIR), "test")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    out = p.STAGES[-1][1](spark, docs, DIR).collect()
    assert sum(r.start + r.length == r.doc_tokens for r in out) == sizes[-1]
    assert p.run(spark, DIR).count() == len(out)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
def test_contract_columns(spark):
    from tempora.llm.queries import QUERIES

    first = {"op1": ["doc_id", "held_out", "lang_pred", "score"], "op2": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op3": ["doc_id", "size", "source_size", "target", "taken"], "op5": ["query_id", "rank", "vec_id", "score"], "op8": ["doc_id", "held_out", "score", "predicted"], "op9": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op10": ["doc_id", "n_shingles", "component_id", "kept"]}
    for name, cols in first.items():
        query = next(f for n, f in QUERIES.items() if n.startswith(f"{name}_"))
        df = query(spark, DIR)
        assert df.columns[: len(cols)] == cols and df.count() > 0
