"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Writing: payloads are compared by SHA-1 over the whole table. Of equal payloads the
one with the smallest page id is stored as ``response``; the others become ``revisit``
records that name it. Payloads below ``least_bytes`` are all responses.
A record's block is an HTTP response: status line, ``Content-Type``,
``Content-Length`` of the payload and, in responses, the payload.

Reading: the dictionary is loaded from the skippable frame, one frame is decoded per
record, and a record is checked: version line, needed headers, block length against
``Content-Length``, the two line ends that close it, payload length and digest.
A fault raises ``ValueError`` with the file and the place.

Defined results: a null payload is an empty one; rows without an id are left out;
rows that share an id are records of their own, each judged by its own payload (the smallest
id of a payload stands once as response for each of its rows), and each has a record id of its own; an empty table gives no archive;
other columns take no part.

An archive is closed at ``file_bytes``, and the next one begun; reading streams frame by frame,
so neither side holds more than a record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.scratch import Scratch

#: The magic number of the skippable frame that holds a dictionary, and of a frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
_END = b"\r\n\r\n"
_DATE = b"2000-01-01T00:00:00Z"  # records carry no crawl time of their own; a fixed date keeps reruns equal


def _id(page_id: int, digest: str, copy: str = "") -> bytes:
    """Of the record of a page with a payload; ``copy`` tells rows apart that are alike in both."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{digest}{copy}')}>".encode()


def record_bytes(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: str = "") -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%b" % (len(payload), _END)
    block = http + payload if refers_to is None else http
    uri = (url or f"urn:page:{page_id}").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + _id(page_id, digest, copy),
        b"WARC-Date: " + _DATE,
        b"WARC-Target-URI: " + uri,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Page-Id: %d" % page_id,
    ]
    if refers_to is not None:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + _id(refers_to, digest),
            b"X-Refers-To-Page-Id: %d" % refers_to,
        ]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + _END + block + _END


def _headers(data: bytes, where: str) -> tuple[dict[bytes, bytes], int]:
    """The named fields up to the first empty line, and where the rest starts."""
    end = data.find(_END)
    if end < 0:
        raise ValueError(f"{where}: headers don't end")
    lines = data[:end].split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{where}: {line[:40]!r} is no header")
        fields[name.strip().lower()] = value.strip()
    return fields, end + len(_END)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_record(data: bytes, where: str) -> tuple[int, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload bytes, digest, type, refers_to and payload (None in revisits) of a checked record."""
    if not data.startswith(VERSION + b"\r\n"):
        raise ValueError(f"{where}: no {VERSION.decode()} record")
    head, at = _headers(data, where)
    try:
        length, kind = int(head[b"content-length"]), head[b"warc-type"].decode()
        page_id, digest = int(head[b"x-page-id"]), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
        head[b"warc-record-id"], head[b"warc-date"]
    except (KeyError, ValueError) as e:
        raise ValueError(f"{where}: missing or bad header: {e}") from e
    block = data[at : at + length]
    if len(block) != length or data[at + length :] != _END:
        raise ValueError(f"{where}: the block has {len(data) - at - len(_END)} bytes, Content-Length says {length}")
    http, body = _headers(block, where)
    size = int(http[b"content-length"])
    if kind == "revisit":
        if len(block) != body:
            raise ValueError(f"{where}: a revisit with a payload")
        refers, payload = int(head[b"x-refers-to-page-id"]), None
        if head[b"warc-refers-to"] != _id(refers, digest):
            raise ValueError(f"{where}: WARC-Refers-To is not the id of page {refers}")
    elif kind == "response":
        refers, payload = None, block[body:]
        if len(payload) != size or sha1_base32(payload) != digest:
            raise ValueError(f"{where}: the payload's length or digest is not what the headers say")
    else:
        raise ValueError(f"{where}: type {kind}")
    return page_id, head[b"warc-target-uri"].decode(), size, digest, kind, refers, payload


def train_dictionary(payloads: list[bytes], size: int = 32_768) -> bytes:
    """A dictionary for small records; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=True, write_checksum=True)


def _writer(folder: str, dictionary: bytes, file_bytes: int):
    """Rows to archives, one after another; a row for each archive. A repeated task leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        compress = _compressor(dictionary)
        names = ("page_id", "url", "payload", "refers_to")
        rows = (r for b in batches for r in zip(*(b.column(c) for c in names), strict=True))
        row, last, copy = next(rows, None), None, 0
        while row is not None:
            store.create_dir(base, recursive=True)
            name, records, size = f"{part:05d}-{number:05d}.warc.zst", 0, 0
            own = f"{base}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                while row is not None and size < file_bytes:
                    page, url, payload, refers = row
                    text = (payload.as_py() or "").encode("utf-8", "surrogatepass")
                    digest = sha1_base32(text)
                    # rows of one page and payload arrive one after another; the first has the id that revisits name
                    copy = copy + 1 if (page.as_py(), digest) == last else 0
                    last = (page.as_py(), digest)
                    frame = compress.compress(record_bytes(*last[:1], url.as_py(), text, digest, refers.as_py(), f":{part}:{copy}" if copy else ""))
                    out.write(frame)
                    records, size, row = records + 1, size + len(frame), next(rows, None)
            store.move(own, f"{base}/{name}")
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records])], ["path", "records"])

    return run


def payload_roles(pages: DataFrame, scratch: Scratch, least_bytes: int = 0) -> DataFrame:
    """``page_id, sha1, refers_to``, once for each id and payload: the page it refers to; null for responses.

    Only ids and digests are compared. Each digest's smallest page is aggregated (with
    map-side combine) and written, so the join of a digest that a third of all pages
    share is one that the adaptive planner splits.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    marks = scratch.table(
        pages.filter("page_id is not null").select(
            F.col("page_id").cast("long").alias("page_id"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).alias("bytes")
        ),
        "digests",
    )
    first = scratch.table(marks.groupBy("sha1").agg(F.min("page_id").alias("first")), "first")
    refers = F.when((F.col("bytes") >= least_bytes) & (F.col("first") != F.col("page_id")), F.col("first"))
    return marks.join(first.hint("merge"), "sha1").select("page_id", "sha1", refers.alias("refers_to")).distinct()


def write_archives(
    pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0, sample: int = 400, file_bytes: int = 1 << 30
) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder`` (a URI that all executors reach); ``path, records``.

    The dictionary is trained on at most ``sample`` pages, those with the smallest hash.
    """
    spark = pages.sparkSession
    roles = scratch.table(payload_roles(pages, scratch, least_bytes).toDF("id", "of", "refers_to"), "roles")
    # a hash threshold leaves about twice the sample, so no task sends its own top rows to the driver
    full = pages.filter("html is not null and page_id is not null").withColumn("h", F.xxhash64("page_id"))
    share = F.col("h").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    near = full.filter(share <= 2.0 * sample / max(1, full.count()))
    picked = near.orderBy("h", "page_id").limit(sample).select("html")
    dictionary = train_dictionary([r["html"].encode("utf-8", "surrogatepass") for r in picked.collect()])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("payload", F.lit("")).cast("binary")))
    rows = rows.join(roles.hint("merge"), (rows["page_id"] == roles["id"]) & (rows["sha1"] == roles["of"]))
    rows = rows.select("page_id", "url", "payload", "refers_to")
    written = rows.mapInArrow(_writer(folder, dictionary, file_bytes), "path string, records long").collect()
    return spark.createDataFrame(sorted((r["path"], r["records"]) for r in written), "path string, records long")


def frames(source: BinaryIO, where: str, step: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time, by the dictionary in its leading skippable frame."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise ValueError(f"{where}: no leading skippable frame with a dictionary")
    size = struct.unpack("<I", head[4:])[0]
    dictionary = source.read(size)
    if len(dictionary) < size:
        raise ValueError(f"{where}: the dictionary is cut off")
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = source.read(step)
    while rest:
        if len(rest) < 4:
            rest += source.read(step)
        if len(rest) < 4 or struct.unpack("<I", rest[:4])[0] != FRAME_MAGIC:
            raise ValueError(f"{where}: no frame where one should begin")
        reader, parts = decode.decompressobj(), []
        while not reader.eof:
            if not rest:
                raise ValueError(f"{where}: the last frame is cut off")
            parts.append(reader.decompress(rest))
            rest = b"" if reader.eof else source.read(step)
        rest = reader.unused_data or source.read(step)
        yield b"".join(parts)


def _reader(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                store, base = fs.FileSystem.from_uri(path)
                rows, seen, held = [], 0, 0
                with store.open_input_stream(base, compression=None) as source:
                    for i, frame in enumerate(frames(source, path)):
                        *fields, payload = parse_record(frame, f"{path}, record {i}")
                        text = payload.decode("utf-8", "surrogatepass") if with_payload and payload is not None else None
                        rows.append((*fields, text))
                        seen, held = seen + 1, held + len(text or "")
                        if len(rows) == 500 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
                if seen != expected:
                    raise ValueError(f"{path}: {seen} records; {expected} were written")

    return run


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record.

    ``archives`` has ``path`` and the ``records`` each must hold. A revisit's
    ``payload`` is null: it is its response's.
    """
    parts = max(1, archives.count())
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload string"
    )
    dealt = archives.repartitionByRange(parts, "path")
    return dealt.mapInArrow(_reader(with_payload), schema)
