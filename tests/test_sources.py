from __future__ import annotations

import struct
import zlib

from minewright.sources import readers


def test_ratings_log(spark, tmp_path):
    (tmp_path / "u.data").write_text("1\t2\t5\t881250949\n3\t4\t1\t881250950\n")
    assert [tuple(r) for r in readers.read_ratings(spark, str(tmp_path / "u.data")).orderBy("user_id").collect()] == [(1, 2, 5, 881250949), (3, 4, 1, 881250950)]


def test_latin_items(spark, tmp_path):
    line = "|".join(["1", "Misérables, Les (1995)", "01-Jan-1995", "", "http://x", *["0"] * 18, "1"])
    (tmp_path / "u.item").write_bytes((line + "\n").encode("latin-1"))
    row = readers.read_items(spark, str(tmp_path / "u.item")).first()
    assert row.movie_title == "Misérables, Les (1995)" and row.Western == 1 and len(row) == 24


def test_header_table(spark, tmp_path):
    (tmp_path / "h.csv").write_text("price,lotsize\n10.5,3\n20,4\n")
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "h.csv"), "price double, lotsize double").orderBy("price").collect()] == [(10.5, 3.0), (20.0, 4.0)]


def test_vectors_keep_line_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for f in range(3):
        (tmp_path / "d" / f"p{f}.csv").write_text("".join(f"{f},{k},255\n" for k in range(4)))
    got = readers.read_vectors(spark, str(tmp_path / "d"), 2, 255.0).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(12)) and got[0].features[1] == 1.0
    for f in range(3):
        own = [r for r in got if r.label == f]
        assert [round(r.features[0] * 255) for r in own] == [0, 1, 2, 3]


def png(width, height, rgb):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels_are_rgb(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(png(4, 3, (10, 20, 30)))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = readers.read_pixels(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and {(r.r, r.g, r.b) for r in rows} == {(10, 20, 30)}
    assert {(r.y, r.x) for r in rows} == {(y, x) for y in range(3) for x in range(4)}
