import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.sources import images as I
from loomlake.sources.footers import listing


def tiff(order, width, height, turn=None, big=False):
    tags = [(0x100, 3, width), (0x101, 4, height)] + ([(0x112, 3, turn)] if turn else [])
    sign = b"II" if order == "<" else b"MM"
    value = lambda form, v: struct.pack(order + {3: "H", 4: "L"}[form], v).ljust(8 if big else 4, b"\0")
    if big:
        return sign + struct.pack(order + "HHHQ", 43, 8, 0, 16) + struct.pack(order + "Q", len(tags)) + b"".join(struct.pack(order + "HHQ", t, f, 1) + value(f, v) for t, f, v in tags)
    return sign + struct.pack(order + "HLH", 42, 8, len(tags)) + b"".join(struct.pack(order + "HHL", t, f, 1) + value(f, v) for t, f, v in tags) + b"\0" * 4


def jpeg(width, height, turn=None, frame=0xC0):
    seg = lambda mark, data: bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data
    preview = seg(0xC0, struct.pack(">BHHB", 8, 9, 9, 1))  # inside another segment
    exif = seg(0xE1, b"Exif\0\0" + tiff(">", 1, 1, turn)) if turn else b""
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0" + preview) + exif + seg(0xE2, b"x" * 60_000) + b"\xff" + seg(frame, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9) + b"\xff\xda"


def png(width, height, turn=None):
    chunk = lambda kind, data: struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">LLBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + (chunk(b"eXIf", tiff("<", 1, 1, turn)) if turn else b"") + chunk(b"IDAT", b"") + chunk(b"IEND", b"")


def webp(width, height, kind, turn=None):
    if kind == "VP8 ":
        body = b"VP8 " + struct.pack("<L", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height)
    elif kind == "VP8L":
        body = b"VP8L" + struct.pack("<LBL", 5, 0x2F, (width - 1) | (height - 1) << 14) + b"\0"
    else:
        exif = tiff("<", 1, 1, turn)
        body = b"VP8X" + struct.pack("<LBBH", 10, 8, 0, 0) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little") + b"ALPH" + struct.pack("<L", 3) + b"abc\0" + b"EXIF" + struct.pack("<L", len(exif)) + exif
    return b"RIFF" + struct.pack("<L", len(body) + 4) + b"WEBP" + body


GOOD = {
    "a.jpg": (jpeg(640, 480), ("JPEG", 640, 480, 1)),
    "b.jpg": (jpeg(65_000, 3, 6, 0xC2), ("JPEG", 65_000, 3, 6)),
    "c.png": (png(10, 20), ("PNG", 10, 20, 1)),
    "d.png": (png(10, 20, 8), ("PNG", 10, 20, 8)),
    "e.gif": (b"GIF89a" + struct.pack("<HH", 7, 8) + b"\0\0\0", ("GIF", 7, 8, 1)),
    "f.bmp": (b"BM" + b"\0" * 12 + struct.pack("<Lll", 40, 5, -6), ("BMP", 5, 6, 1)),
    "g.bmp": (b"BM" + b"\0" * 12 + struct.pack("<LHH", 12, 5, 6), ("BMP", 5, 6, 1)),
    "h.webp": (webp(33, 44, "VP8 "), ("WEBP", 33, 44, 1)),
    "i.webp": (webp(16_384, 2, "VP8L"), ("WEBP", 16_384, 2, 1)),
    "j.webp": (webp(70_000, 5, "VP8X", 3), ("WEBP", 70_000, 5, 3)),
    "k.tif": (tiff("<", 100, 200, 5), ("TIFF", 100, 200, 5)),
    "l.tif": (tiff(">", 100, 70_000), ("TIFF", 100, 70_000, 1)),
    "m.tif": (tiff("<", 9, 8, 2, big=True), ("TIFF", 9, 8, 2)),
    "n.jpg": (jpeg(4, 5, 77), ("JPEG", 4, 5, 1)),
}


def test_headers():
    for name, (data, want) in GOOD.items():
        assert I.header(data) == (*want, None), name


def test_faulty_bytes_are_errors():
    r = random.Random(0)
    for data, _ in GOOD.values():
        for n in [*range(0, min(len(data), 40)), len(data) // 2]:
            got = I.header(data[:n])
            assert (got[4] is None) == (got[1] is not None)
        for _ in range(200):
            bad = bytearray(data)
            for _ in range(4):
                bad[r.randrange(min(len(bad), 120))] = r.randrange(256)
            got = I.header(bytes(bad))
            assert (got[4] is None) == (got[1] is not None)
    assert I.header(jpeg(0, 5))[4] == "of no size" and I.header(b"text")[4] and I.header(b"")[4]


def test_files(spark, tmp_path):
    for name, (data, _) in GOOD.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "x.jpg").write_bytes(b"\xff\xd8\xff")
    files = listing(spark, str(tmp_path), "*").select(F.regexp_replace("path", "^file:/*", "file:///").alias("path"), "length")
    more = spark.createDataFrame([(None, 1), (f"file://{tmp_path}/gone.jpg", 2)], files.schema)
    got = {(r.path or "").rsplit("/", 1)[-1]: r for r in I.image_headers(spark, files.unionByName(more)).collect()}
    assert {n: (r.format, r.width, r.height, r.orientation) for n, r in got.items() if not r.error} == {n: want for n, (_, want) in GOOD.items()}
    assert got["x.jpg"].error == "ends too early" and got["gone.jpg"].error and got[""].error == "no path"
    df = spark.createDataFrame([(n, d) for n, (d, _) in GOOD.items()] + [("x", b"no"), ("y", None)], "n string, d binary")
    got = {r.n: r.h for r in df.select("n", I.header_of(F.col("d")).alias("h")).collect()}
    assert {n: tuple(h)[:4] for n, h in got.items() if n in GOOD} == {n: want for n, (_, want) in GOOD.items()} and got["x"].error and got["y"].error == "no content"


@pytest.mark.parametrize("turn", range(1, 9))
def test_boxes_of_turned_pictures(spark, turn):
    """Against pixels: a marked box of a picture that is turned as EXIF says."""
    w, h, box = 12, 7, [2, 1, 5, 3]
    pixels = np.zeros((h, w), int)
    pixels[box[1] : box[3], box[0] : box[2]] = 1
    shown = {1: pixels, 2: pixels[:, ::-1], 3: pixels[::-1, ::-1], 4: pixels[::-1], 5: pixels.T, 6: pixels[::-1].T, 7: pixels[::-1, ::-1].T, 8: pixels[:, ::-1].T}[turn]
    df = spark.createDataFrame([(box, w, h, turn)], "box array<int>, w int, h int, turn int")
    got = df.select(I.upright_box(F.col("box"), F.col("w"), F.col("h"), F.col("turn")).alias("b"), I.upright(F.col("w"), F.col("h"), F.col("turn")).alias("s")).first()
    ys, xs = np.nonzero(shown)
    assert got.b == [xs.min(), ys.min(), xs.max() + 1, ys.max() + 1] and (got.s.height, got.s.width) == shown.shape
