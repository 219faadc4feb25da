"""WARC archives with a Zstandard dictionary.

A file begins with a skippable frame that holds a dictionary, built from the
file's own first records; after it every record is a Zstandard frame of its own,
compressed with that dictionary, so records can be read singly by offset and
length. Equal payloads are stored once: the record with the largest id is the
response, others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm import blocks as B
from tempora.llm import files
from tempora.llm.frames import arrow, join_hot, new_path, saved

#: Fixed values of the format: the magic number of the leading dictionary frame, the profile of equal payloads.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_FROM = 1000  # bytes of a payload from which equal ones are revisits
ARCHIVE_BYTES = 64 << 20  # of payload, after which a file is closed
SAMPLE_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record; ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    own = page_id if page_id is not None else f"none-{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few or too alike for training, their last bytes as they are."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one file; the dictionary is built once ``SAMPLE_BYTES`` of records wait, or at the end."""

    def __init__(self, uri: str):
        self.uri, self.out, self.at, self.waiting, self.size, self.payload = uri, files.writer(uri), 0, [], 0, 0
        self.packer = None
        self.placed: list[tuple] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _start(self) -> None:
        made = dictionary([r for _, r in self.waiting])
        raw = made.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True, write_checksum=True)
        waiting, self.waiting = self.waiting, []
        for x in waiting:
            self._frame(*x)

    def _frame(self, key, data: bytes) -> None:
        frame = self.packer.compress(data)
        self.placed.append((key, self.uri, self.at, len(frame)))
        self._put(frame)

    def add(self, key, data: bytes) -> None:
        self.payload += len(data)
        if self.packer is not None:
            return self._frame(key, data)
        self.waiting.append((key, data))
        self.size += len(data)
        if self.size >= SAMPLE_BYTES:
            self._start()

    def close(self) -> list[tuple]:
        if self.packer is None:
            self._start()
        self.out.close()
        return self.placed


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row as a record into files of ``folder``; (page_id, archive, offset, length) of each record.

    A null payload counts as empty, a null url leaves its header out. A payload
    of ``REVISIT_FROM`` bytes and more that several rows have is the response of
    the largest id among them (of all rows with that id, if it repeats; of all,
    if no row has an id), the rest revisit it; a null id revisits too. Smaller
    payloads are always responses. A very long payload is one record, held in
    memory once. Payloads are never shuffled, only digests. Extra columns are
    ignored. An empty table writes nothing.
    """
    c = lambda n: F.col(f"`{n}`")
    payload = F.coalesce(c(payload_col).cast("string"), F.lit(""))
    rows = pages.select(c(id_col).cast("long").alias("page_id"), c(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    blocks = B.write(rows, ["page_id", "digest", "n"], "pages")
    large = blocks.placed.filter(F.col("n") >= REVISIT_FROM).select("block", "i", "page_id", "digest")
    largest = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("times")).filter("times > 1 and response is not null")
    largest = saved(largest, "repeated")
    told = join_hot(large, largest, "digest", large.count())
    told = told.filter(~F.col("page_id").eqNullSafe(F.col("response"))).select("block", "i", F.col("response").alias("refers_to"))
    files.make_dir(folder)

    def run(visits) -> Iterator[pa.RecordBatch]:
        archive, part = None, TaskContext.get().partitionId()

        def placed(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["page_id", "archive", "offset", "length"])

        for _, uri, revisits in visits:
            response = dict(zip(revisits.column("i").to_pylist(), revisits.column("refers_to").to_pylist(), strict=True))
            row = 0
            for batch in B.read(uri):
                for k in range(batch.num_rows):
                    page_id, url, payload, digest = (batch.column(j)[k].as_py() for j in range(4))
                    archive = archive or Archive(files.own_name(folder, "pages", part, ".warc.zst"))
                    archive.add(page_id, record(page_id, url, payload.encode(), digest, response.get(row)))
                    row += 1
                    if archive.payload >= ARCHIVE_BYTES:
                        yield placed(archive.close())
                        archive = None
        if archive:
            yield placed(archive.close())

    return saved(B.visit(blocks, told, run, "page_id long, archive string, offset long, length long"), "warc-index")


def open_dictionary(f) -> tuple[zstandard.ZstdCompressionDict, int]:
    """The dictionary in a file's leading frame, and the offset after it."""
    magic, size = struct.unpack("<II", f.read_at(8, 0))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the file does not begin with a dictionary")
    return zstandard.ZstdCompressionDict(f.read_at(size, 8)), 8 + size


def read_record(uri: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: headers and block."""
    with files.reader(uri) as f:
        made, _ = open_dictionary(f)
        return parse(zstandard.ZstdDecompressor(dict_data=made).decompress(f.read_at(length, offset)))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(_END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != _END:
        raise ValueError("a record's length does not match its header")
    return headers, rest[:n]


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a file in order, without an index."""
    with files.reader(uri) as f:
        made, at = open_dictionary(f)
        f.seek(at)
        unpack, rest = zstandard.ZstdDecompressor(dict_data=made), b""
        while True:
            one, parts = unpack.decompressobj(), []
            while not one.eof:
                rest = rest or f.read(1 << 20)
                if not rest:
                    if parts:
                        raise ValueError("the file ends inside a record")
                    return
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
            yield parse(b"".join(parts))


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the files in ``archives`` (archive): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response's digest and length are computed from its stored payload and must
    match its headers; a revisit has those of its headers and a null payload. Very
    long payloads come whole. Without archives the frame is empty.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for h, block in records(uri):
                    digest, n, kind, payload = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), int(h["X-Payload-Length"]), h["WARC-Type"], None
                    if kind == "response":
                        payload = block.partition(_END)[2]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
                            raise ValueError(f"a payload in {uri} is damaged")
                    held.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), kind, number(h.get("WARC-Refers-To")), n, digest, payload))
                    size += len(block) + 100
                    if size > BATCH_BYTES:
                        yield pa.record_batch([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)

    return archives.select("archive").transform(arrow, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op2_warc(spark, sf_dir):
    """Contract query: write all pages, read the archives back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archives(pages, new_path(spark, "warc"))
    archives = index.select("archive").distinct()
    n = archives.count()
    return read_archives(archives.repartition(max(1, n))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""
