"""Image headers: size, validity and orientation from the first bytes of a file, without decoding a pixel.

JPEG, PNG, GIF, BMP, WebP and TIFF. JPEG segments are followed to the frame header, so an embedded preview or a large
profile in front of it is passed over; orientation comes from EXIF (JPEG, WebP, PNG) or the image directory (TIFF). A file
that ends before its header does, states a size of zero or is of another kind is not valid, and says why; no file is a
failure of the job.
"""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.sources.files import opened

# Fixed values of the formats.
_JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_ALONE = {0x01, *range(0xD0, 0xD8)}
_WIDTH, _HEIGHT, _ORIENTATION = 0x100, 0x101, 0x112
_INTEGERS = {1: "B", 3: "H", 4: "L", 16: "Q"}

_SCHEMA = pa.schema([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("error", pa.string())])
HEADER = "format string, width int, height int, orientation int, error string"
_HEADER = T.StructType([T.StructField("format", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("width", "height", "orientation")], T.StructField("error", T.StringType())])


class BadImage(ValueError):
    pass


class _Source:
    """Bytes by place; those beyond the end are an error."""

    def __init__(self, source):
        self.source, self.size = source, len(source) if isinstance(source, (bytes, memoryview)) else source.size()

    def at(self, place: int, n: int) -> bytes:
        if place < 0 or place + n > self.size:
            raise BadImage("ends too early")
        if isinstance(self.source, (bytes, memoryview)):
            return bytes(self.source[place : place + n])
        self.source.seek(place)
        return self.source.read(n)

    def take(self, form: str, place: int) -> tuple:
        return struct.unpack(form, self.at(place, struct.calcsize(form)))


def _directory(s: _Source, base: int) -> dict[int, int]:
    """The whole numbers of the first image directory of TIFF data at base."""
    order = {b"II": "<", b"MM": ">"}.get(s.at(base, 2))
    if order is None:
        raise BadImage("no byte order")
    (kind,) = s.take(order + "H", base + 2)
    big = kind == 43
    if kind not in (42, 43):
        raise BadImage("no TIFF data")
    (at,) = s.take(order + ("Q" if big else "L"), base + (8 if big else 4))
    (n,) = s.take(order + ("Q" if big else "H"), base + at)
    at += 8 if big else 2
    entry = struct.Struct(order + ("HHQ8s" if big else "HHL4s"))
    out = {}
    for i in range(min(n, 4096)):
        tag, form, count, value = entry.unpack(s.at(base + at + i * entry.size, entry.size))
        if tag in (_WIDTH, _HEIGHT, _ORIENTATION) and form in _INTEGERS and count == 1:
            out[tag] = struct.unpack_from(order + _INTEGERS[form], value)[0]
    return out


def _orientation(s: _Source, base: int) -> int:
    """1 to 8, 1 where nothing or something else is said."""
    try:
        turn = _directory(s, base).get(_ORIENTATION, 1)
    except BadImage:
        return 1
    return turn if 1 <= turn <= 8 else 1


def _jpeg(s: _Source) -> tuple:
    at, turn = 2, 1
    while True:
        if s.take("B", at)[0] != 0xFF:
            raise BadImage("no segment")
        mark = s.take("B", at + 1)[0]
        if mark == 0xFF:  # filling
            at += 1
            continue
        if mark in _ALONE:
            at += 2
            continue
        if mark in (0xD9, 0xDA):
            raise BadImage("no frame header")
        (size,) = s.take(">H", at + 2)
        if mark in _JPEG_FRAMES:
            height, width = s.take(">HH", at + 5)
            return "JPEG", width, height, turn
        if mark == 0xE1 and size >= 8 and s.at(at + 4, 6) == b"Exif\0\0":
            turn = _orientation(s, at + 10)
        if size < 2:
            raise BadImage("a segment without length")
        at += 2 + size


def _png(s: _Source) -> tuple:
    size, kind, width, height = s.take(">L4sLL", 8)
    if kind != b"IHDR" or size != 13:
        raise BadImage("no IHDR")
    at, turn = 8, 1
    while at + 12 <= s.size:
        size, kind = s.take(">L4s", at)
        if kind == b"eXIf":
            turn = _orientation(s, at + 8)
        if kind in (b"eXIf", b"IDAT", b"IEND"):
            break
        at += 12 + size
    return "PNG", width, height, turn


def _webp(s: _Source) -> tuple:
    kind = s.at(12, 4)
    if kind == b"VP8 ":
        if s.at(23, 3) != b"\x9d\x01\x2a":
            raise BadImage("no key frame")
        width, height = s.take("<HH", 26)
        return "WEBP", width & 0x3FFF, height & 0x3FFF, 1
    if kind == b"VP8L":
        sign, bits = s.take("<BL", 20)
        if sign != 0x2F:
            raise BadImage("no lossless frame")
        return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
    if kind != b"VP8X":
        raise BadImage("no frame")
    flags = s.at(20, 1)[0]
    width, height = (int.from_bytes(s.at(at, 3), "little") + 1 for at in (24, 27))
    at, turn = 12, 1
    while flags & 8 and at + 8 <= s.size:
        kind, size = s.take("<4sL", at)
        if kind == b"EXIF":
            turn = _orientation(s, at + (14 if s.size >= at + 14 and s.at(at + 8, 6) == b"Exif\0\0" else 8))
            break
        at += 8 + size + size % 2
    return "WEBP", width, height, turn


def _bmp(s: _Source) -> tuple:
    (size,) = s.take("<L", 14)
    width, height = s.take("<HH" if size == 12 else "<ll", 18)
    return "BMP", width, abs(height), 1


def _tiff(s: _Source) -> tuple:
    tags = _directory(s, 0)
    if _WIDTH not in tags or _HEIGHT not in tags:
        raise BadImage("no size")
    turn = tags.get(_ORIENTATION, 1)
    return "TIFF", tags[_WIDTH], tags[_HEIGHT], turn if 1 <= turn <= 8 else 1


def header(source) -> tuple:
    """(format, width, height, orientation, error) of a file or bytes, as stored: an orientation of 5 to 8 swaps sides."""
    s = _Source(source)
    try:
        head = s.at(0, min(16, s.size))
        if head[:3] == b"\xff\xd8\xff":
            found = _jpeg(s)
        elif head[:8] == b"\x89PNG\r\n\x1a\n":
            found = _png(s)
        elif head[:6] in (b"GIF87a", b"GIF89a"):
            found = "GIF", *s.take("<HH", 6), 1
        elif head[:2] == b"BM":
            found = _bmp(s)
        elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            found = _webp(s)
        elif head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
            found = _tiff(s)
        else:
            raise BadImage("of no known kind")
        if not (0 < found[1] < 1 << 31 and 0 < found[2] < 1 << 31):
            raise BadImage("of no size")
        return *found, None
    except BadImage as e:
        return None, None, None, None, str(e)


def image_headers(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files (path, and other columns, kept) with format, width, height, orientation and error, read by the executors from
    the first bytes of each file. A path that is null or cannot be opened is a row with an error."""
    names = files.columns

    def run(batches):
        for b in batches:
            found = []
            for path in b.column(names.index("path")).to_pylist():
                if path is None:
                    found.append((None, None, None, None, "no path"))
                    continue
                try:
                    with opened(path) as source:
                        found.append(header(source))
                except (OSError, pa.ArrowInvalid) as e:
                    found.append((None, None, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t.type) for c, t in zip(zip(*found), _SCHEMA)]], names=[*names, *_SCHEMA.names])

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", " + HEADER
    return files.mapInArrow(run, schema)


@F.pandas_udf(_HEADER)
def header_of(contents: pd.Series) -> pd.DataFrame:
    """The header of image bytes as a struct."""
    rows = [header(x) if x is not None else (None, None, None, None, "no content") for x in contents]
    return pd.DataFrame(rows, columns=_SCHEMA.names).astype({"width": "Int32", "height": "Int32", "orientation": "Int32"})


def upright(width: Column, height: Column, orientation: Column) -> Column:
    """(width, height) of the picture as it is shown."""
    swaps = orientation >= 5
    return F.struct(F.when(swaps, height).otherwise(width).alias("width"), F.when(swaps, width).otherwise(height).alias("height"))


def upright_box(box: Column, width: Column, height: Column, orientation: Column) -> Column:
    """A box [x1, y1, x2, y2] of the stored picture, of that size, in the picture as it is shown."""
    x1, y1, x2, y2 = (box[i] for i in range(4))
    w, h = width, height
    to = {1: (x1, y1, x2, y2), 2: (w - x2, y1, w - x1, y2), 3: (w - x2, h - y2, w - x1, h - y1), 4: (x1, h - y2, x2, h - y1), 5: (y1, x1, y2, x2), 6: (h - y2, x1, h - y1, x2), 7: (h - y2, w - x2, h - y1, w - x1), 8: (y1, w - x2, y2, w - x1)}
    out = F.when(orientation == 1, F.array(*to[1]))
    for k in range(2, 9):
        out = out.when(orientation == k, F.array(*to[k]))
    return out.otherwise(box)
