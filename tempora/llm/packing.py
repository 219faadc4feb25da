"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and saves its ids with the document's
offset among the tokens of its run: the rows of its task or, for a saved table,
rows that follow each other in a file. The runs' totals, one number for each
run, give by a prefix sum the global offset of every document. Pass 2 cuts the
concatenation into fixed windows and yields a boundary record for each piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.bpe import encoder
from tempora.llm.columns import pieces
from tempora.llm.frames import arrow, saved

WINDOW, END_ID = 1024, 0
BATCH_BYTES = 4 << 20


def token_ids(docs: DataFrame, id_col: str, text_col: str, json_path: str, ranks_path: str | None = None, end_id: int = END_ID, stored: bool = False) -> DataFrame:
    """(id, file, part, before, n, ids): ids of each text with the end id, little-endian 32-bit; ``before`` counts the run's earlier ids.

    A run is a task, and ``part`` its number. With ``stored`` it is a stretch of
    rows of one file, and ``part`` its first row's index.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("file", T.StringType()), T.StructField("part", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, run_of, part, total, last = encoder(json_path, ranks_path), "", TaskContext.get().partitionId(), 0, -1
        for whole, a, b in _stretches(batches, stored):
            if stored:
                name, index = whole.column(2)[a].as_py(), whole.column(3)[a].as_py()
                if name != run_of or index != last + 1:
                    run_of, part, total = name, index, 0
                last = index + b - a - 1
            batch = whole.slice(a, b - a)
            for a, b in pieces(batch.column(1), BATCH_BYTES):
                ids, at = codec.column(batch.column(1).slice(a, b - a))
                out = np.insert(ids, at[1:], end_id).astype("<u4")
                ends = at[1:] + np.arange(1, b - a + 1)
                n = np.diff(ends, prepend=0)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(out)])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([run_of] * (b - a), pa.string()), pa.array(np.full(b - a, part, np.int64)), pa.array(total + ends - n), pa.array(n), data.cast(pa.binary())], names=["id", "file", "part", "before", "n", "ids"])
                total += int(ends[-1])

    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")] if stored else []
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *place).transform(arrow, run, schema)


def _stretches(batches: Iterator[pa.RecordBatch], stored: bool) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """(batch, first row, end row) of rows that follow each other in one file, or of whole batches."""
    for batch in batches:
        cuts = np.zeros(0, int)
        if stored and batch.num_rows:
            file = batch.column(2).dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(batch.column(3).to_numpy()) != 1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        yield from ((batch, a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def write_order(file: str) -> tuple:
    """Sorts Spark's files by the partition that wrote them, then by that partition's file; others come last, by name."""
    found = re.search(r"part-(\d+)-[^/]*?(?:-c(\d+))?\.[^/]*$", file)
    return (0, int(found[1]), int(found[2] or 0), file) if found else (1, 0, 0, file)


def pack(docs: DataFrame, id_col: str, text_col: str, json_path: str, ranks_path: str | None = None, window: int = WINDOW, end_id: int = END_ID, stored: bool = False) -> DataFrame:
    """Boundary records of all documents packed into sequences of ``window`` ids.

    Returns per piece: id; start, its document's ids before it; length; doc_tokens
    with the end id; sequence_id; offset in the sequence, gapless from 0; ids, the
    piece's ids as little-endian unsigned 32-bit. Only the last sequence can be
    short of the window.

    A null or empty text is the end id alone. A null id stays null; equal rows are
    packed each for itself. A text longer than the window fills several sequences.
    Extra columns are ignored, whatever their names. An empty table gives an empty
    frame.

    Documents are packed in the order of partitions. A scan of files has an order
    of its own, by size; with ``stored``, for Parquet that Spark wrote, they are
    packed in the order in which they were written, however the scan deals them.
    """
    tokens = saved(token_ids(docs, id_col, text_col, json_path, ranks_path, end_id, stored), "tokens")
    totals = tokens.groupBy("file", "part").agg(F.sum("n").alias("n")).collect()  # a row for each run
    totals = sorted((write_order(r["file"]), r["part"], r["n"]) for r in totals)
    ends = np.cumsum([n for *_, n in totals]).tolist()
    shared = docs.sparkSession.sparkContext.broadcast({(name[-1], part): end - n for (name, part, n), end in zip(totals, ends, strict=True)})
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(x, T.LongType()) for x in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = shared.value
        for whole in batches:
            for x, y in pieces(whole.column(5), BATCH_BYTES):
                batch = whole.slice(x, y - x)
                if batch.num_rows == 0:
                    continue
                n = batch.column(4).to_numpy()
                base = np.array([bases[k] for k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
                first = base + batch.column(3).to_numpy()
                count = (first + n - 1) // window - first // window + 1
                row = np.repeat(np.arange(len(n)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                seq = first[row] // window + nth
                begin = np.maximum(first[row], seq * window)
                end = np.minimum(first[row] + n[row], (seq + 1) * window)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(0, np.cumsum((end - begin) * 4)).astype(np.int64)), pa.py_buffer(b"".join(batch.column(5).to_pylist()))])
                yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(begin - first[row]), pa.array(end - begin), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * window), data.cast(pa.binary())], names=schema.names)

    return tokens.select("id", "file", "part", "before", "n", "ids").transform(arrow, run, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int | None = None) -> DataFrame:
    """(sequence_id, n, ids) of whole sequences; with ``pad_id`` the last is filled up to the window.

    A group has at most ``window`` pieces.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    if pad_id is not None:
        one = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
        ids = F.concat(ids, F.aggregate(F.array_repeat(one, (F.lit(window) - F.col("n")).cast("int")), F.lit(b""), lambda acc, x: F.concat(acc, x)))
    return parts.select("sequence_id", "n", ids.alias("ids"))


def op9_packing(spark, sf_dir):
    """Contract query: all documents, byte-level BPE ids, windows of 1024."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return d.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
