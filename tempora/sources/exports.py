"""Training examples out of evidence: JSON lines and Parquet.

examples: id, question, answer, rejected, evidence (array of strings), path (array
of strings), valid_at, known_at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("id", "question", "answer", "evidence", "path")


def checked(examples: DataFrame) -> DataFrame:
    """``examples``, raising when one is read that lacks a field, an answer or evidence."""
    missing = [c for c in REQUIRED if c not in examples.columns]
    if missing:
        raise ValueError(f"examples lack {', '.join(missing)}")
    bad = F.col("id").isNull() | F.col("question").isNull() | F.col("answer").isNull() | (F.coalesce(F.size("evidence"), F.lit(0)) == 0)
    return examples.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("incomplete example "), F.coalesce("id", F.lit("without id"))))).otherwise(F.col("id")))


def _message(role: str, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def supervised(examples: DataFrame) -> DataFrame:
    """(value): chat examples that answer a question from its evidence."""
    e = checked(examples)
    prompt = F.concat(F.col("question"), F.lit("\n\nEvidence:\n"), F.array_join("evidence", "\n"))
    return e.select(F.to_json(F.struct("id", F.array(_message("user", prompt), _message("assistant", F.col("answer"))).alias("messages"))).alias("value"))


def preferences(examples: DataFrame) -> DataFrame:
    """(value): pairs of the chosen and the rejected answer, of examples that have both."""
    e = checked(examples).filter("rejected is not null")
    return e.select(F.to_json(F.struct("id", F.array(_message("user", F.col("question"))).alias("prompt"), F.array(_message("assistant", F.col("answer"))).alias("chosen"), F.array(_message("assistant", F.col("rejected"))).alias("rejected"))).alias("value"))


def retrieval_examples(examples: DataFrame) -> DataFrame:
    e = checked(examples)
    return e.select(F.to_json(F.struct(*[c for c in e.columns])).alias("value"))


def path_supervision(examples: DataFrame) -> DataFrame:
    """(id, hop, node): paths as rows, for Parquet."""
    return checked(examples).select("id", F.posexplode("path").alias("hop", "node"))


def write_lines(values: DataFrame, path: str) -> None:
    values.write.mode("errorifexists").text(path)
