"""Ingestion: lines, directives, candidates, CSV, HTML titles, secrets; and the evaluation files' records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import scalar as fx

#: What marks a secret in a text.
SECRET_PATTERNS = (r"(?i)\b(api[_-]?key|secret|password|token)\s*[=:]\s*\S+", r"\bsk-[A-Za-z0-9]{16,}\b", r"\bAKIA[0-9A-Z]{16}\b")


def line_chunks(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line, byte_start, byte_end, content): a chunk for each line that isn't blank, with its place after trimming."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    with_ends = docs.select(F.col(id).alias("id"), lines.alias("lines"))
    rows = with_ends.select("id", F.posexplode("lines").alias("line", "raw"))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("raw") + 1).over(w), F.lit(0))
    lead = F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", r"^\s+", ""))
    content = F.regexp_replace("raw", r"^\s+|\s+$", "")
    t = rows.withColumn("at", at).withColumn("content", content).withColumn("byte_start", F.col("at") + lead)
    return t.filter("content != ''").select("id", "line", "byte_start", (F.col("byte_start") + F.octet_length("content")).alias("byte_end"), "content")


def candidates(chunks: DataFrame) -> DataFrame:
    """``candidate: s | p | o | valid=a..b | confidence=c | evidence=q`` lines as columns; malformed ones have an error and nulls."""
    body = F.trim(F.regexp_replace("content", r"^candidate:", ""))
    parts = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
    t = chunks.filter(F.col("content").startswith("candidate:")).withColumn("p", parts).withColumn("ok", F.size("p") == 6)
    at = lambda i: F.when(F.col("ok"), F.get("p", F.lit(i)))
    valid = F.regexp_extract(at(3), r"^valid=(-?\d*)\.\.(-?\d*)$", 1), F.regexp_extract(at(3), r"^valid=(-?\d*)\.\.(-?\d*)$", 2)
    number = lambda c: F.when(c != "", c.cast("long"))
    return t.select("id", at(0).alias("subject_text"), at(1).alias("predicate_text"), at(2).alias("object_text"), number(valid[0]).alias("valid_from"), number(valid[1]).alias("valid_to"), F.try_to_number(F.regexp_extract(at(4), r"^confidence=(.*)$", 1), F.lit("9.99")).cast("double").alias("confidence"), F.regexp_extract(at(5), r"^evidence=(.*)$", 1).alias("evidence_text"), "byte_start", "byte_end", F.when(~F.col("ok"), "malformed").alias("error"))


def directives(chunks: DataFrame) -> DataFrame:
    """``entity:``, ``assertion:``, ``event:`` and ``causal:`` lines: their kind, and a map of their key=value fields."""
    kind = F.regexp_extract("content", r"^(entity|assertion|event|causal):", 1)
    fields = F.transform(F.split(F.regexp_replace("content", r"^\w+:", ""), r"\|"), lambda x: F.trim(x))
    pairs = F.filter(fields, lambda x: x.contains("="))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v")))
    # of a repeated key the first holds
    first = F.filter(entries, lambda x, i: F.array_position(F.transform(entries, lambda y: y["k"]), x["k"]) == i + 1)
    return chunks.withColumn("kind", kind).filter("kind != ''").select("id", "line", "kind", F.map_from_entries(first).alias("fields"))


def csv_rows(chunks: DataFrame) -> DataFrame:
    """Lines of at least four unquoted fields, none of the first four empty, after the header: subject, predicate, object, evidence."""
    p = F.transform(F.split("content", ","), lambda x: F.trim(x))
    t = chunks.withColumn("p", p).filter((F.col("line") > 0) & (F.size("p") >= 4))
    cols = [F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("subject", "predicate", "object", "evidence"))]
    return t.select("id", *cols, F.lit(0.6).alias("confidence")).filter("subject != '' and predicate != '' and object != '' and evidence != ''")


def html_titles(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    title = F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select(F.col(id), F.trim(title).alias("title")).filter("title != ''")


def json_entity(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The first string values of the keys entity, type and evidence."""
    key = lambda k: F.regexp_extract(F.col(text), rf'"{k}"\s*:\s*"([^"]*)"', 1)
    return docs.select(F.col(id), key("entity").alias("entity"), key("type").alias("type"), key("evidence").alias("evidence")).filter("entity != ''")


def redact_secrets(text: Column) -> Column:
    """Secrets as [REDACTED], key=value ones with their key kept."""
    out = F.regexp_replace(text, SECRET_PATTERNS[0], "$1=[REDACTED]")
    for p in SECRET_PATTERNS[1:]:
        out = F.regexp_replace(out, p, "[REDACTED]")
    return out


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for p in SECRET_PATTERNS:
        out |= text.rlike(p)
    return out


def commands(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, assertions) of approved candidates, ids as slugs; pending ones raise an error when the frames are read."""
    status = F.when(F.col("review") == "pending", F.raise_error(F.lit("a candidate is not reviewed"))).otherwise(F.col("review"))
    ok = reviewed.withColumn("review", status).filter("review = 'approved'")
    names = ok.select(F.col("subject_text").alias("name")).union(ok.select("object_text"))
    entities = names.select(fx.slugify(F.col("name")).alias("id"), F.col("name").alias("canonical_name")).dropDuplicates(["id"])
    rows = ok.select(fx.slugify(F.col("subject_text")).alias("subject"), fx.slugify(F.col("predicate_text")).alias("predicate"), fx.slugify(F.col("object_text")).alias("object"), "valid_from", "valid_to", "confidence", "evidence_text")
    return entities, rows


def read_eval_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A pipe-delimited evaluation file as frames of its records: cases, evidence, paths, contradictions."""
    lines = spark.read.text(path).filter("trim(value) != '' and not startswith(value, '#')")
    t = lines.select(F.trim(F.substring_index("value", ":", 1)).alias("kind"), F.transform(F.split(F.regexp_replace("value", r"^[^:]*:", ""), r"\|"), lambda x: F.trim(x)).alias("p"))
    names = {
        "case": ["id", "question", "answer", "valid_at", "known_at", "tags", "gold_evidence_ids", "required_path_ids", "gold_contradiction_ids"], "evidence": ["id", "subject", "predicate", "object", "valid_from", "valid_to", "known_from", "text"],
        "path": ["id", "evidence_ids"], "contradiction": ["id", "assertion_a", "assertion_b", "contradiction_type"],
    }
    number, many = {"valid_at", "known_at", "valid_from", "valid_to", "known_from"}, {"tags", "gold_evidence_ids", "required_path_ids", "gold_contradiction_ids", "evidence_ids"}

    def column(i, n):
        c = F.get("p", F.lit(i))
        if n in number:
            return F.when(c.rlike(r"^-?\d+$"), c.cast("long")).alias(n)
        if n in many:
            return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias(n)
        return c.alias(n)

    return {kind: t.filter(F.col("kind") == kind).select(*[column(i, n) for i, n in enumerate(cols)]) for kind, cols in names.items()}


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated scenarios with # comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema)


def ingest(docs: DataFrame, id: str, text: str, modality: str) -> dict[str, DataFrame]:
    """One batch of documents as six frames: sources, evidence, directives, candidates, embeddings and review tasks.

    ``modality`` names what the documents are; candidates come from lines of
    ``csv``, from the ``json`` or ``html`` as a whole, else from candidate lines.
    A source has one embedding and each of its evidence lines one; every
    candidate and every source is a task, by id.
    """
    src = F.concat(F.lit("source-"), F.col(id).cast("string"))
    sources = docs.select(src.alias("source_id"), F.lit(modality).alias("modality"), F.md5(text).alias("content_hash"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"))
    chunks = line_chunks(docs, id, text).withColumn("id", F.concat(F.lit("source-"), F.col("id").cast("string")))
    evidence = chunks.select(F.col("id").alias("source_id"), F.concat_ws(":", "id", "line").alias("evidence_id"), "byte_start", "byte_end", F.col("content").alias("text"))
    if modality == "csv":
        found = csv_rows(chunks).select("id", F.concat_ws("|", "subject", "predicate", "object").alias("claim"))
    elif modality == "json":
        found = json_entity(docs.select(src.alias("id"), F.col(text).alias("text")), "id", "text").select("id", F.concat_ws("|", "entity", "type").alias("claim"))
    elif modality == "html":
        found = html_titles(docs.select(src.alias("id"), F.col(text).alias("html")), "id").select("id", F.col("title").alias("claim"))
    else:
        found = candidates(chunks).filter("error is null").select("id", F.concat_ws("|", "subject_text", "predicate_text", "object_text").alias("claim"))
    found = found.select(F.col("id").alias("source_id"), F.concat_ws(":", F.lit("candidate"), "id", F.md5("claim")).alias("candidate_id"), "claim")
    embeddings = docs.select(src.alias("owner"), fx.byte_embedding(F.coalesce(F.col(text), F.lit(""))).alias("embedding")).union(evidence.select("evidence_id", fx.byte_embedding(F.col("text"))))
    tasks = found.select(F.col("candidate_id").alias("task"), F.lit("candidate").alias("kind")).union(sources.select("source_id", F.lit("source"))).distinct()
    return {"sources": sources, "evidence": evidence, "directives": directives(chunks), "candidates": found, "embeddings": embeddings, "tasks": tasks}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def encrypt(df: DataFrame, column: str, key: str) -> DataFrame:
    """The column as AES-GCM ciphertext under a hex key."""
    return df.withColumn(column, F.aes_encrypt(F.col(column), F.unhex(F.lit(key)), F.lit("GCM")))


def decrypt(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(F.col(column), F.unhex(F.lit(key)), F.lit("GCM")).cast("string"))


def rotate_key(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return encrypt(decrypt(df, column, old), column, new)


def encode_parts(parts: Column) -> Column:
    """An array of strings as length:value runs, lengths in bytes."""
    return F.array_join(F.transform(parts, lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), "")


def decode_parts(record: str) -> list[str]:
    """The inverse, for single driver-side records."""
    data, at, out = record.encode(), 0, []
    while at < len(data):
        stop = data.index(b":", at)
        n = int(data[at:stop])
        if len(data) < stop + 1 + n:
            raise ValueError("the record ends inside a part")
        out.append(data[stop + 1 : stop + 1 + n].decode())
        at = stop + 1 + n
    return out


def synthetic_social(spark: SparkSession, entities: int, assertions: int, branch: int = 16) -> DataFrame:
    """(id, subject, predicate, object): a graph of n entities in which each knows the next ``branch``."""
    i = F.col("id")
    s = i % entities
    return spark.range(assertions).select(F.concat(F.lit("a-"), i.cast("string")).alias("aid"), F.concat(F.lit("e-"), s.cast("string")).alias("subject"), F.lit("knows").alias("predicate"), F.concat(F.lit("e-"), ((s + 1 + F.floor(i / entities) % branch) % entities).cast("string")).alias("object"))


def synthetic_chain(spark: SparkSession, n: int, predicate: str = "owns") -> DataFrame:
    """(id, subject, predicate, object): a chain of n + 1 entities."""
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("a-"), i.cast("string")).alias("aid"), F.concat(F.lit("e-"), i.cast("string")).alias("subject"), F.lit(predicate).alias("predicate"), F.concat(F.lit("e-"), (i + 1).cast("string")).alias("object"))


def synthetic_supply(spark: SparkSession, n: int) -> DataFrame:
    """(aid, subject, predicate, object, valid_from, valid_to): parts with two suppliers each, whose times overlap by half."""
    i = F.col("id")
    part, second = F.floor(i / 2), i % 2
    return spark.range(2 * n).select(F.concat(F.lit("a-"), i.cast("string")).alias("aid"), F.concat(F.lit("part-"), part.cast("string")).alias("subject"), F.lit("SUPPLIED_BY").alias("predicate"), F.concat(F.lit("supplier-"), ((part + second) % n).cast("string")).alias("object"), (part * 10 + second * 5).alias("valid_from"), (part * 10 + second * 5 + 10).alias("valid_to"))


def synthetic_memories(spark: SparkSession, n: int, agents: int = 8) -> DataFrame:
    """(id, agent_id, content, embedding): memories of several agents with one-hot embeddings of four dimensions."""
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("mem-"), i.cast("string")).alias("id"), F.concat(F.lit("agent-"), (i % agents).cast("string")).alias("agent_id"), F.concat(F.lit("memory number "), i.cast("string")).alias("content"), fx.one_hot(i).alias("embedding"))
