"""The registered queries of this subpackage; `__spark_entry__.py` adds them if it can be imported."""

from __future__ import annotations

from tempora.llm import neardup, topk, warc
from tempora.llm.langid import op1_language_id
from tempora.llm.media import op6_media_columns
from tempora.llm.mixing import op3_mixing
from tempora.llm.packing import op9_packing
from tempora.llm.quality import op4_quality_classifier
from tempora.llm.toxicity import op8_toxicity
from tempora.llm.wordpiece import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_language_id, warc.op2_warc, op3_mixing, op4_quality_classifier, topk.op5_exact_top_k, op6_media_columns, op7_token_counts, op8_toxicity, op9_packing, neardup.op10_minhash_near_dedup)
}
ORACLES: dict[str, str] = {"op2_warc": warc.OP2_SQL, "op5_exact_top_k": topk.OP5_SQL, "op10_minhash_near_dedup": neardup.OP10_SQL}
