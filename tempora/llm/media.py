"""Media columns: content-addressed payloads in tar shards.

A row carries its payload's digest and where its stored form lies: shard, offset
and length. Shards are plain tar files, members are named by their digest. Equal
payloads are stored once. Digests that occur more than once are marked in a
bitmap of bounded size; rows outside it are written by the task that read them,
without a shuffle, and only marked rows (copies, and the few that share a bit)
are grouped by digest. Metadata columns come from range reads of the headers.

The stored form is a PNG of 8-bit RGB samples, 64 pixels wide.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import files
from tempora.llm.frames import arrow, new_path, saved

ROW, WIDTH, PAD = 192, 64, b" "
SHARD_BYTES = 256 << 20
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 27, 16  # of the bitmap of repeated digests: 16 for each of them, 16 MB at most
HEADER_BYTES = 33  # PNG signature and IHDR
#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a positive multiple of ``ROW``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, out of the first ``HEADER_BYTES`` bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def decode(media: bytes) -> bytes:
    """The payload of a stored form."""
    _, height, _ = header(media)
    at, parts = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            parts.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, ROW + 1)
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Height, mean colour and an average hash of 8 x 8 cells, as text."""
    px = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH, 3)
    mean = px.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (len(px) * WIDTH)
    grey = px.sum(axis=2, dtype=np.int64).reshape(len(px), 8, 8).sum(axis=2)  # 8 columns of cells
    edges = np.arange(9) * len(px) // 8
    total = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(grey, axis=0)])
    size = np.maximum(np.diff(edges), 1)[:, None]
    top = np.minimum(edges[:-1], len(px) - 1)
    cells = np.where(np.diff(edges)[:, None] > 0, total[edges[1:]] - total[edges[:-1]], grey[top]) / size
    bits = "".join("1" if x else "0" for x in (cells > cells.mean()).ravel())
    return f"{len(px)}:{':'.join(map(str, mean))}:{int(bits, 2):016x}"


class Shard:
    """One tar file being written."""

    def __init__(self, uri: str):
        self.uri, self.out, self.at, self.held = uri, files.writer(uri), 0, {}

    def put(self, digest: str, media: bytes) -> tuple[int, int]:
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % 512))
            self.held[digest] = (self.at + 512, len(media))
            self.at += 512 + len(media) + (-len(media) % 512)
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def _padded(text):
    n = F.octet_length(text)
    return F.concat(text, F.repeat(F.lit(" "), F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW))).cast("int")))


def _repeated(digests: DataFrame) -> bytes:
    """A bitmap of the digests (digest) that occur more than once, of a power of two of bits that their number asks for.

    Past ``MOST_BITS`` it fills up: more rows than needed are then grouped by digest, none is lost.
    """
    many = saved(digests.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * many.count()).bit_length()))
    many = many.select((F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1).alias("v"))
    maps = many.groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m"))
    out = bytearray(bits // 8)
    for r in maps.collect():  # at most MOST_BITS / 32768 rows of 4 KB
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["m"]
    return bytes(out)


def _written(rows: DataFrame, folder: str, marked: bytes | None) -> DataFrame:
    """Store rows (id, n, digest, text); those marked in the bitmap pass on with their text instead."""
    shared = rows.sparkSession.sparkContext.broadcast(marked)
    schema = T.StructType([rows.schema["id"], *[T.StructField(n, t) for n, t in (("n", T.LongType()), ("digest", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("text", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, part, shard = shared.value, TaskContext.get().partitionId(), None
        for batch in batches:
            later = np.zeros(batch.num_rows, bool)
            if bitmap is not None:
                bit = batch.column(4).to_numpy()
                later = (np.frombuffer(bitmap, np.uint8)[bit >> 3] >> (bit & 7)) & 1 == 1
            places = []
            for i, digest in enumerate(batch.column(2).to_pylist()):
                if later[i]:
                    places.append((None, None, None))
                    continue
                if shard is None or shard.at >= SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard = Shard(files.own_name(folder, "media", part, ".tar"))
                raw = batch.column(3)[i].as_py().encode()
                places.append((shard.uri, *shard.put(digest, encode(raw + PAD * (-len(raw) % ROW if raw else ROW)))))
            text = pa.array([batch.column(3)[i].as_py() if x else None for i, x in enumerate(later)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([p[j] for p in places], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))], text], names=schema.names)
        if shard:
            shard.close()

    return rows.transform(arrow, run, schema)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Store every text's payload; (objects, copies).

    The payload is the UTF-8 text, filled with spaces up to a positive multiple
    of 192 bytes. ``objects``: id, n, digest (of the payload), shard, offset,
    length of what is stored, one row each; id is null for a payload of several
    rows. ``copies``: id, n, digest of those rows. A null text counts as empty;
    a null id is kept; extra columns are ignored; an empty table stores nothing.
    """
    files.make_dir(folder)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(text).cast("long").alias("n"), F.sha2(_padded(text).cast("binary"), 256).alias("digest"), text.alias("text"))
    marked = _repeated(rows.select("digest"))
    placed = saved(_written(rows.withColumn("bit", F.pmod(F.xxhash64("digest"), F.lit(8 * len(marked)))), folder, marked), "media-rows")
    many = placed.filter("text is not null")
    one = many.groupBy("digest").agg(F.first("text").alias("text"), F.first("n").alias("n")).select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "n", "digest", "text")
    late = saved(_written(one, folder, None), "media-copies")
    cols = ["id", "n", "digest", "shard", "offset", "length"]
    alone = placed.filter("text is null")
    objects = alone.select(*cols, F.lit(True).alias("alone")).union(late.select(*cols, F.lit(False)))
    return objects, many.select("id", "n", "digest")


def _each_object(objects: DataFrame, columns: list[tuple[str, T.DataType, pa.DataType]], read) -> DataFrame:
    """``objects`` with further columns that ``read(file, offset, length)`` gives; a shard is opened once in a row."""
    schema = T.StructType([*objects.schema.fields, *[T.StructField(n, t) for n, t, _ in columns]])
    names = objects.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, f = None, None
        for batch in batches:
            got = []
            for shard, offset, length in zip(*[batch.column(names.index(n)).to_pylist() for n in ("shard", "offset", "length")], strict=True):
                if shard != at:
                    if f:
                        f.close()
                    at, f = shard, files.reader(shard)
                got.append(read(f, offset, length))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([g[i] for g in got], t) for i, (_, _, t) in enumerate(columns)]], names=schema.names)
        if f:
            f.close()

    return objects.transform(arrow, run, schema)


def with_metadata(objects: DataFrame) -> DataFrame:
    """``objects`` with width, height and bits, from reads of the headers only."""
    read = lambda f, offset, length: header(f.read_at(min(HEADER_BYTES, length), offset))
    return _each_object(objects, [(n, T.IntegerType(), pa.int32()) for n in ("width", "height", "bits")], read)


def with_payload_digests(objects: DataFrame) -> DataFrame:
    """``objects`` with digests and a feature of what is stored, read back whole."""

    def read(f, offset, length):
        media = f.read_at(length, offset)
        payload = decode(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)

    long, text = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
    return _each_object(objects, [("payload_bytes", *long), ("payload_sha256", *text), ("tail_crc32", *long), ("media_bytes", *long), ("media_sha256", *text), ("feature", *text)], read)


def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", fill=with_metadata) -> DataFrame:
    """One row per document: id, n, digest, shard, offset, length and what ``fill`` adds, as by :func:`store`."""
    objects, copies = store(docs, folder, id_col, text_col)
    filled = saved(fill(objects), "media-columns")
    added = [c for c in filled.columns if c not in ("id", "n", "alone")]
    shared = filled.filter("not alone").select(*added)
    out = ["id", "n", *added]
    return filled.filter("alone").select(*out).union(copies.join(shared, "digest").select(*out))


def op6_media_columns(spark, sf_dir):
    """Contract query: every document's text as a payload, stored, read back and described."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fill = lambda objects: with_payload_digests(with_metadata(objects))
    m = media_columns(docs, new_path(spark, "media"), fill=fill)
    return m.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bits")
