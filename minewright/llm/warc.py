"""WARC archives compressed with Zstandard: writer, reader and validation.

A .warc.zst file starts with a skippable frame that holds the dictionary; after it, each record is
one Zstandard frame. Files are written and read through pyarrow's file systems, which take the
URI of the shared folder (file:, hdfs:, s3:).
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.llm.common import join_groups, materialize, new_path

#: Fixed values of the format: magic of the dictionary's skippable frame, magic of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
DATE = "2020-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with an HTTP block, or a revisit that keeps only the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), b"", block, b"", b""])


def parse_record(data: bytes) -> dict:
    """A record's fields and payload facts; raises WarcError if a header, length or digest is wrong."""
    top, gap, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not gap or lines[0].encode() != VERSION:
        raise WarcError(f"not a WARC record: {data[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name) or name.lower() in fields:
            raise WarcError(f"bad header line: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    if missing := [x for x in MANDATORY if x.lower() not in fields]:
        raise WarcError(f"headers missing: {missing}")
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length says {fields['content-length']}")
    block = rest[:length]
    if fields.get("warc-block-digest", "") not in ("", f"sha1:{hashlib.sha1(block).hexdigest()}"):
        raise WarcError("block digest differs")
    head, gap, payload = block.partition(b"\r\n\r\n")
    http_length = re.search(rb"(?im)^content-length: *(\d+)\r?$", head)
    if not gap or not head.startswith(b"HTTP/") or not http_length:
        raise WarcError("no HTTP head in the block")
    digest = fields.get("warc-payload-digest", "")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(http_length[1]) or digest != f"sha1:{hashlib.sha1(payload).hexdigest()}"):
        raise WarcError("payload length or digest differs")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("a revisit has a payload or names no record")
    if kind not in ("response", "revisit"):
        raise WarcError(f"type {kind}")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(http_length[1]), "payload_digest": digest.removeprefix("sha1:"),
        "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from the samples; with too few of them, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class ArchiveWriter:
    """Writes one archive: the dictionary's skippable frame, then a frame per record."""

    def __init__(self, sink: BinaryIO, dictionary: bytes, level: int = 3):
        self.sink, self.bytes = sink, 0
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        shared = zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.frames.compress(record))


def read_archive(source: BinaryIO, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one per frame, read as a stream."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != DICTIONARY_MAGIC:
        raise WarcError("no dictionary frame at the start")
    packed = source.read(size := struct.unpack("<II", head)[1])
    if len(packed) != size:
        raise WarcError("the dictionary frame is cut")
    plain = struct.unpack_from("<I", packed)[0] == FRAME_MAGIC if size >= 4 else False
    dictionary = zstandard.ZstdDecompressor().decompress(packed) if plain else packed
    kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None)
    data = source.read(chunk)
    while data:
        frame, parts = frames.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data or source.read(chunk)
                    break
                data = source.read(chunk)
                if not data:
                    raise WarcError("the last frame is cut")
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        yield b"".join(parts)


def with_revisits(pages: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """pages as page_id, url, html, digest, refers_to: of equal payloads of `least` bytes or more, the largest id stays."""
    html = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col("url") if "url" in pages.columns else F.lit(None)).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html").cast("long"), "check": F.xxhash64("html")})
    groups = rows.filter(F.col("n") >= least).groupBy("digest", "n", "check").agg(F.max("page_id").alias("stays"), F.count("*").alias("size"))
    groups = materialize(groups.filter("size > 1 AND stays IS NOT NULL"), "payloads")
    rows = join_groups(rows, groups, ["digest", "n", "check"], "size", "page_id")
    return rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("stays")), F.col("stays")).alias("refers_to"))


def write_archives(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = 1000, archive_bytes: int = 64 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 32 << 10, folder: str | None = None) -> DataFrame:
    """Write a record per row; returns the manifest (path, records, bytes) of finished archives.

    A task fills archives of about `archive_bytes` before compression. Each has a dictionary of its own,
    trained on its first `sample_bytes` of records. A file's name is new in every attempt of a task and
    only finished attempts reach the manifest, so a lost executor leaves stray files, never wrong ones.
    Of equal payloads (SHA-1, length and a second hash agree) of `least` bytes or more, the record with
    the largest page_id is a response and the others revisit it; all others are responses. Null html is
    an empty payload, a null id stays null, repeated rows are records of their own. No rows, no archive.
    """
    folder = folder or new_path(pages.sparkSession, "warc")

    def work(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held, size, writer, records, done = [], 0, None, 0, []
        path = sink = None

        def start():
            nonlocal path, sink, writer, records
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            sink = store.open_output_stream(path)
            writer = ArchiveWriter(sink, train_dictionary(held, dictionary_bytes))
            for record in held:
                writer.add(record)
            records = len(held)
            held.clear()

        def finish():
            nonlocal writer, size
            sink.close()
            done.append((f"{folder}/{path.rsplit('/', 1)[1]}", records, writer.bytes))
            writer, size = None, 0

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, url, html, digest, refers = (x.as_py() for x in row)
                record = record_bytes(page, url, html, digest, refers)
                size += len(record)
                if writer:
                    writer.add(record)
                    records += 1
                else:
                    held.append(record)
                    if size >= sample_bytes:
                        start()
                if size >= archive_bytes:
                    if held:
                        start()
                    finish()
        if held:
            start()
        if writer:
            finish()
        columns = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    rows = with_revisits(pages, id_col, text_col, least)
    return materialize(rows.mapInArrow(work, "path string, records long, bytes long"), "manifest")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives in manifest (path, records), each validated; see parse_record().

    payload_bytes and payload_digest are those of the full payload, for revisits too. With payloads, a
    last column has the bytes (null in revisits). An archive is streamed: a task holds a record and
    the rows of a batch. A wrong frame, header, length, digest or number of records raises WarcError.
    """
    schema = RECORD + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads]

    def work(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                rows, size, n = [], 0, 0
                with store.open_input_stream(name) as source:
                    for data in read_archive(source):
                        record = parse_record(data)
                        rows.append([record[x] for x in names])
                        size += 200 + (len(record["payload"] or b"") if payloads else 0)
                        n += 1
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if n != expected:
                    raise WarcError(f"{path} holds {n} records, the manifest says {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path", "records").repartition(spread, "path").mapInArrow(work, schema)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
     q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS stays FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stays THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stays THEN stays END AS refers_to
FROM q
"""
