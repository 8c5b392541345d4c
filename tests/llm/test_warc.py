from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.errors import PySparkException

from minewright.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], SCHEMA).repartition(3)


def brute(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        stays = max(same, default=None)
        again = len(data) >= 1000 and stays is not None and i != stays
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", stays if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/\r\nX: y", "é" * 600), (7, "http://b", "é" * 600), (3, None, "é" * 600), (4, "u", "s" * 999), (5, "u", "s" * 999), (6, "u", "s" * 1000), (8, "u", "s" * 1000),
    (9, "u", None), (10, "u", ""), (11, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "s" * 1000), (12, "u", "z" * 3_000_000), (13, "u", "dup" * 400), (13, "u", "dup" * 400),
]


@pytest.mark.parametrize("archive", [1000, 64 << 20])
def test_round_trip(spark, archive):
    manifest = warc.write_archives(pages(spark, ROWS), archive_bytes=archive, sample_bytes=2000)
    got = warc.read_archives(manifest, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response" and r.page_id is not None) == sorted((h or "").encode() for i, _, h in ROWS if i in {r.page_id for r in got if r.record_type == "response"})
    assert sum(r.records for r in manifest.collect()) == len(ROWS)
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%0D%0AX:%20y"}


def test_empty(spark):
    manifest = warc.write_archives(pages(spark, []))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_a_record_too_many_is_found(spark):
    manifest = warc.write_archives(pages(spark, ROWS[:3])).selectExpr("path", "records + 1 AS records")
    with pytest.raises(PySparkException, match="manifest says"):
        warc.read_archives(manifest).collect()


def archive(records, dictionary=b"dictionary " * 20):
    sink = io.BytesIO()
    writer = warc.ArchiveWriter(sink, dictionary)
    for r in records:
        writer.add(r)
    return sink.getvalue()


GOOD = warc.record_bytes(5, "http://x", b"hello", hashlib.sha1(b"hello").hexdigest(), None)


def test_layout():
    data = archive([GOOD, GOOD])
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    frames = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert frames.startswith(b"dictionary")
    assert list(warc.read_archive(io.BytesIO(data), chunk=3)) == [GOOD, GOOD]
    raw = b"dictionary " * 20  # a dictionary that isn't compressed is read as well
    plain = struct.pack("<II", magic, len(raw)) + raw + data[8 + size :]
    assert list(warc.read_archive(io.BytesIO(plain))) == [GOOD, GOOD]
    assert list(warc.read_archive(io.BytesIO(archive([GOOD], b"")))) == [GOOD]


@pytest.mark.parametrize("cut", [4, 20, -3])
def test_cut_archives(cut):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(archive([GOOD])[:cut])))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(archive([GOOD]) + b"trailing bytes")))


@pytest.mark.parametrize(
    ("old", "new"),
    [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: 83", b"Content-Length: 84"), (b"hello", b"hullo"), (b"WARC-Date", b"WARC-Data"), (b"WARC-Type: response", b"WARC-Type: other"), (b"\r\n\r\n", b"\n\n"), (b"WARC-Target-URI:", b"bad header:")],
)
def test_bad_records(old, new):
    assert warc.parse_record(GOOD)["payload"] == b"hello" and old in GOOD
    with pytest.raises(warc.WarcError):
        warc.parse_record(GOOD.replace(old, new))
