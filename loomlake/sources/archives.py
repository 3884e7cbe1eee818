"""ZIP archives as rows: one row for each member, with its place in the archive; contents are inflated by the executors.

Executors open archives through the file system that their URI names. The table of members is read from the end of a file
alone: the end record, its 64-bit form where there is one, and the central directory. So a listing of many large archives
reads little, members can be chosen by name before anything is inflated, and each is read by its own byte range, by any
number of tasks. An archive that is no ZIP, is cut short or names places outside itself is one row with an error; Spark lists no empty files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.files import located, opened
from loomlake.sources.footers import listing

# Fixed values of the ZIP format: signatures and record layouts, little-endian.
END, END64_AT, END64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06", b"PK\x01\x02", b"PK\x03\x04"
_END = struct.Struct("<4s4H2LH")
_END64_AT = struct.Struct("<4sLQL")
_END64 = struct.Struct("<4sQ2H2L4Q")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
STORED, DEFLATED = 0, 8

_MEMBERS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("encrypted", pa.bool_()), ("error", pa.string())])
_MEMBER_ROWS = "archive string, name string, method int, at long, packed long, size long, crc long, encrypted boolean, error string"
_CONTENT_ROWS = "archive string, name string, content binary, error string"
_CONTENTS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])


class BadArchive(ValueError):
    pass


def _range(source, at: int, size: int, total: int) -> bytes:
    if at < 0 or size < 0 or at + size > total:
        raise BadArchive(f"bytes {at} to {at + size} of {total}")
    source.seek(at)
    return source.read(size)


def _directory(source) -> tuple[int, int, int, int]:
    """(place, length, number of members, bytes in front of the archive) of the central directory."""
    total = source.size()
    tail = _range(source, max(0, total - _END.size - 65_535), min(total, _END.size + 65_535), total)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise BadArchive("no end record")
        if at + _END.size <= len(tail) and at + _END.size + _END.unpack_from(tail, at)[-1] <= len(tail):
            break
    _, disk, start_disk, _, count, size, place, _ = _END.unpack_from(tail, at)
    if disk != start_disk:
        raise BadArchive("an archive of several files")
    end = total - len(tail) + at
    if count == 0xFFFF or size == 0xFFFFFFFF or place == 0xFFFFFFFF:
        where = end - _END64_AT.size
        sign, _, far, _ = _END64_AT.unpack(_range(source, where, _END64_AT.size, total)) if where >= 0 else (b"", 0, 0, 0)
        if sign == END64_AT:
            sign, *_, count, size, place = _END64.unpack(_range(source, far, _END64.size, total))
            if sign != END64:
                raise BadArchive("no 64-bit end record")
            end = far
    return place, size, count, end - place - size


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and place with those of the 64-bit field where 32 bits do not hold them."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            field, k = extra[at + 4 : at + 4 + n], 0
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF and k + 8 <= len(field):
                    values[i] = struct.unpack_from("<Q", field, k)[0]
                    k += 8
            break
        at += 4 + n
    return values


def entries(source) -> Iterator[tuple]:
    """(name, method, place of its local header, packed size, size, crc, encrypted) of each member but folders."""
    place, size, count, before = _directory(source)
    if before < 0:
        raise BadArchive("the directory is longer than the file")
    data = _range(source, place + before, size, source.size())
    at = 0
    for _ in range(count):
        if at + _ENTRY.size > len(data):
            raise BadArchive("the directory is cut short")
        sign, _, _, flags, method, _, _, crc, packed, whole, n, m, k, _, _, _, local = _ENTRY.unpack_from(data, at)
        if sign != ENTRY or at + _ENTRY.size + n + m + k > len(data):
            raise BadArchive("no directory entry")
        raw = data[at + _ENTRY.size : at + _ENTRY.size + n]
        name = raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        whole, packed, local = _wide(data[at + _ENTRY.size + n : at + _ENTRY.size + n + m], [whole, packed, local])
        at += _ENTRY.size + n + m + k
        if not name.endswith("/"):
            yield name, method, local + before, packed, whole, crc, bool(flags & 1)


def content(source, method: int, at: int, packed: int, size: int, crc: int, most: int) -> bytes:
    """A member's bytes, of its stated length and checksum."""
    total = source.size()
    head = _LOCAL.unpack(_range(source, at, _LOCAL.size, total))
    if head[0] != LOCAL:
        raise BadArchive("no local header")
    if size > most:
        raise BadArchive(f"{size} bytes, more than {most}")
    data = _range(source, at + _LOCAL.size + head[-2] + head[-1], packed, total)
    if method == DEFLATED:
        pump = zlib.decompressobj(-15)
        data = pump.decompress(data, size + 1)  # no more than it says, whatever it holds
    elif method != STORED:
        raise BadArchive(f"method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise BadArchive("length or checksum differs")
    return data


def zip_members(spark: SparkSession, root: str, name_part: str = "", glob: str = "*.zip", per_task: int = 64) -> DataFrame:
    """(archive, name, method, at, packed, size, crc, encrypted, error): the members of the archives below root whose own
    name holds name_part. A faulty archive is one row with an error."""

    def run(batches):
        for b in batches:
            rows = []
            for archive in b.column(0).to_pylist():
                try:
                    with opened(archive) as source:
                        rows += [(archive, *e, None) for e in entries(source)]
                except (BadArchive, struct.error) as e:
                    rows.append((archive, *[None] * 7, str(e)))
                if len(rows) > 50_000:
                    yield _batch(rows, _MEMBERS)
                    rows = []
            if rows:
                yield _batch(rows, _MEMBERS)

    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    files = listing(spark, root, glob).where(F.contains(stem, F.lit(name_part))).select(F.col("path").alias("archive"))
    tasks = max(1, min(-(-files.count() // per_task), 4096), min(8, spark.sparkContext.defaultParallelism))
    return files.repartition(tasks).mapInArrow(run, _MEMBER_ROWS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def member_contents(members: DataFrame, most: int = 1 << 30, tasks: int | None = None) -> DataFrame:
    """(archive, name, content, error) of members, dealt by archive and place, so that one archive is read by many tasks. A
    member of more than ``most`` bytes, or that is encrypted, faulty or packed in another way than by deflate, is a row with
    an error; so are the rows of faulty archives."""

    def run(batches):
        current, source = None, None
        for b in batches:
            rows, held = [], 0
            for archive, name, method, at, packed, size, crc, locked, error in zip(*(c.to_pylist() for c in b.columns)):
                data = None
                if error is None:
                    try:
                        if locked:
                            raise BadArchive("encrypted")
                        if archive != current:
                            current, source = archive, opened(archive)
                        data = content(source, method, at, packed, size, crc, most)
                    except (BadArchive, struct.error, zlib.error) as e:
                        error = str(e)
                rows.append((archive, name, data, error))
                held += len(data or b"")
                if held > 32 << 20:
                    yield _batch(rows, _CONTENTS)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _CONTENTS)

    tasks = tasks or members.sparkSession.sparkContext.defaultParallelism
    slim = members.select(*_MEMBERS.names)
    return slim.repartitionByRange(tasks, "archive", "at").sortWithinPartitions("archive", "at").mapInArrow(run, _CONTENT_ROWS)


def extract_zips(spark: SparkSession, root: str, to: str, name_part: str = "") -> DataFrame:
    """Every member of the archives written below ``to`` (a URI), in a folder named as its archive. (archive, name, path,
    error); a member that would lie outside its folder is a row with an error. Tasks that run again write the same files."""

    def run(batches):
        files, base = located(to)
        schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("path", pa.string()), ("error", pa.string())])
        for b in batches:
            rows = []
            for archive, name, data, error in zip(*(c.to_pylist() for c in b.columns)):
                path = None
                if error is None:
                    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
                    if ".." in parts or name.startswith("/") or not parts:
                        error = "leaves its folder"
                    else:
                        place = "/".join([archive.rsplit("/", 1)[1].rsplit(".", 1)[0], *parts])
                        files.create_dir(f"{base}/{place}".rsplit("/", 1)[0], recursive=True)
                        with files.open_output_stream(f"{base}/{place}") as out:
                            out.write(data)
                        path = f"{to.rstrip('/')}/{place}"
                rows.append((archive, name, path, error))
            if rows:
                yield _batch(rows, schema)

    from loomlake.sources.scratch import written

    return written(member_contents(zip_members(spark, root, name_part)).mapInArrow(run, "archive string, name string, path string, error string"))
