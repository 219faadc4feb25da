"""Rows stored as blocks: files that are visited again, together with what is told of their rows.

Wide rows (texts, payloads) stay where a task read them. The task writes them as
blocks of about ``BLOCK_BYTES`` into the shared folder and passes on, for each
row, its place (block, i) and the narrow columns that others have to know.
Whatever joins and aggregates find out about rows is told back by place, so only
narrow rows are ever shuffled, and a place is exact where a hashed key is not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import files
from tempora.llm.frames import arrow, new_path, saved, trim

BLOCK_BYTES, LEVEL = 48 << 20, 5
_BITS = 24  # of a block's number that count the blocks of one task


@dataclass
class Blocks:
    """``placed``: block, i, uri (of a block's first row, else null) and the narrow columns; ``parts``: tasks that wrote; ``schema``: of what is stored."""

    placed: DataFrame
    parts: int
    schema: T.StructType


def write(rows: DataFrame, narrow: list[str], name: str = "blocks") -> Blocks:
    """Store ``rows``. A block holds rows of one task and is closed once it has ``BLOCK_BYTES``; one row is never split."""
    folder = new_path(rows.sparkSession, name)
    files.make_dir(folder)
    at = [rows.columns.index(c) for c in narrow]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("uri", T.StringType()), *[rows.schema.fields[k] for k in at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            if out is None:
                uri, row, size = files.own_name(folder, "block", part, ".arrow"), 0, 0
                out = files.writer(uri)
                stream = pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL)))
            stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, (part << _BITS) + nth)), pa.array(np.arange(row, row + n, dtype=np.int32)), pa.array([uri if row + k == 0 else None for k in range(n)], pa.string()), *[batch.column(k) for k in at]], names=schema.names
            )
            row, size = row + n, size + batch.nbytes
            if size >= BLOCK_BYTES:
                stream.close()
                out.close()
                nth, out = nth + 1, None
        if out is not None:
            stream.close()
            out.close()

    placed = saved(rows.transform(arrow, run, schema), name)
    parts = (placed.agg(F.max(F.shiftright("block", _BITS))).first()[0] or 0) + 1
    return Blocks(placed, parts, rows.schema)


def read(uri: str) -> Iterator[pa.RecordBatch]:
    """A block's rows, in the batches in which they were written."""
    with files.reader(uri) as f:
        for batch in pa.ipc.open_stream(f):
            yield batch
            del batch
            trim()


def visit(blocks: Blocks, told: DataFrame | None, run: Callable, schema) -> DataFrame:
    """Record batches that ``run`` yields out of its visits: (block, uri, rows of ``told`` (block, ...) for it, without the block).

    A task makes the visits to what one task wrote, so tasks are as even as those
    of the scan; told rows travel there, a block's together.
    """
    extra = [] if told is None else [f for f in told.schema.fields if f.name != "block"]
    rows = blocks.placed.filter("uri is not null").select("block", "uri", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    if told is not None:
        rows = rows.union(told.select("block", F.lit(None).cast("string"), *[f.name for f in extra]))
    rows = rows.repartitionById(blocks.parts, F.shiftright("block", _BITS).cast("int")).sortWithinPartitions("block", F.desc_nulls_last("uri"))

    def visits(batches: Iterator[pa.RecordBatch]):
        block, uri, held = None, None, []
        for batch in batches:
            b = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y == x:
                    continue
                if b[x] != block:
                    if block is not None:
                        yield block, uri, pa.Table.from_batches(held)
                    block, uri, held = int(b[x]), batch.column(1)[x].as_py(), []
                    x += 1  # the block's own row comes first
                held.append(pa.RecordBatch.from_arrays(batch.columns[2:], names=batch.schema.names[2:]).slice(x, y - x) if extra else pa.RecordBatch.from_pydict({"none": pa.nulls(0)}))
        if block is not None:
            yield block, uri, pa.Table.from_batches(held)

    return rows.transform(arrow, lambda batches: run(visits(batches)), schema)


def marks(told: pa.Table, n: int, column: str = "i") -> np.ndarray:
    """Which of a block's first n rows are told by their index."""
    out = np.zeros(n, bool)
    i = told.column(column).drop_null().to_numpy()
    out[i[i < n]] = True
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
