"""A training-data pipeline over ``documents`` made of the operators in ``tempora.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import langid, mixing, neardup, packing, quality
from tempora.tables import discard, saved, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is over their language's limit go; trusted are those labelled of quality 1.

    Null and empty texts are scored on their end alone, very long ones whole; a
    null id is never trusted, a null language takes the limit of all. Rows that
    repeat are decided alike. Without documents, or trusted ones, nothing goes.
    """
    return quality.keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: no letter, or too close between two languages.

    So null and empty texts go. A null label only doesn't train; without any
    label all go. Very long texts count whole, rows that repeat go together.
    """
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays.

    That with the least id; a row that repeats it stays once. Null and wordless
    texts are near nothing, very long ones are compared whole; a null id stays
    only where its group has no other. No documents give none.
    """
    return neardup.keep_one(docs, "doc_id", "text", shingle=5, num=4, den=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents in training order, as often as the mix takes them.

    Null and wordless texts are never taken; null sources are one source; ties in
    position go by a key of id and text; rows that repeat count each; very long
    texts are taken whole but for the last copy of a source. No documents give none.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed in training order, that in which the mix was written, into sequences of 1024 ids; one row per piece, without the ids themselves but their checksum.

    Null and empty texts are their end id alone, very long ones fill several
    sequences, null ids and rows that repeat are packed each. No documents give none.
    """
    import public_tokenizers

    if not docs.inputFiles():  # only a written mix has an order of files
        docs = saved(docs, "mix")
    d = packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), stored=True)
    return d.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_id),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go once its result is written
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
