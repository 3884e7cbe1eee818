"""Token files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of whole documents, one after the other, little-endian:

    magic | block* | block starts (u64) | document ids (i64), their null flags (u8), ids of each document (i64) | footer

    block := count u16 | exceptions u16 | width u8 | minimum u32 | packed values | places u16 * exceptions | rest u32 * exceptions

A block holds up to ``BLOCK`` ids. Their minimum is subtracted, and each difference is packed in ``width`` bits, the number
of bits that ``percentile`` of the differences need. The bits above that of the others, the exceptions, stand in the list
behind the packed values. 64 values fill ``width`` words of 64 bits. The footer names the places of the parts, so a span of
ids is read by the index of block starts, without the blocks before it.

Documents are ordered by ranges of (id, hash of the text), so a hot id is spread over tasks, and each task writes files of
about ``file_ids`` ids through the file system that the folder's URI names. A task's files get names of their own, and the
manifest holds the files of the tasks that Spark counted: a task that is lost and run again leaves a file that nothing names.
The place of a file's first id is the sum of the files before it; the manifest has one row a file.

Null ids come first and stay null; a null or empty text is the end id alone; rows with one id stand by the hash of their
text, then by the text; repeated rows are written each; a very long text is one document of many blocks; an empty table has
an empty manifest and no file. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, scratch_dir, texts_of
from loomlake.llm.token_fst import encoder, groups

BLOCK = 1024
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<HHBI")
#: documents, ids, blocks, place of the block starts, place of the document table
_FOOT = struct.Struct("<QQQQQ8s")
_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
_MANIFEST_ROWS = "part long, file long, path string, docs long, ids long, bytes long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DOC_ROWS = "doc_id long, start long, n_tokens long, ids binary"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """values (rows x 64, below 2^width) -> rows x width words of 64 bits."""
    out = np.zeros((len(values), width), np.uint64)
    for lane in range(64 if width else 0):
        word, shift = divmod(lane * width, 64)
        v = values[:, lane].astype(np.uint64)
        out[:, word] |= v << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The reverse of pack: rows x width words -> rows x 64 values."""
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64 if width else 0):
        word, shift = divmod(lane * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, lane] = v & mask
    return out


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """Blocks of the ids; all but the last have BLOCK of them."""
    n = -(-len(ids) // BLOCK)
    count = np.full(n, BLOCK)
    count[-1:] = len(ids) - (n - 1) * BLOCK
    rows = np.zeros(n * BLOCK, np.uint32)
    rows[: len(ids)] = ids
    if n:
        rows[len(ids) :] = ids[-int(count[-1]) :].min()
    rows = rows.reshape(n, BLOCK)
    low = rows.min(axis=1, keepdims=True)
    rows = rows - low
    at = np.sort(rows, axis=1)
    # the places of the last block's padding are zeros in front
    rank = BLOCK - count + np.ceil(percentile * count).astype(np.int64) - 1
    width = np.array([int(x).bit_length() for x in at[np.arange(n), np.maximum(rank, 0)]], np.int64)
    over = rows >> np.minimum(width, 31)[:, None].astype(np.uint32) if n else rows
    over[width == 32] = 0
    words: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        kept = rows[some] if w == 32 else rows[some] & np.uint32((1 << int(w)) - 1)
        packed = pack(kept.reshape(-1, 64), int(w)).reshape(len(some), -1)
        for i, p in zip(some, packed):
            words[i] = p[: -(-int(count[i]) // 64) * int(w)]
    out = []
    for i in range(n):
        places = np.flatnonzero(over[i]).astype(np.uint16)
        out.append(_HEAD.pack(count[i], len(places), width[i], int(low[i, 0])) + words[i].astype("<u8").tobytes() + places.astype("<u2").tobytes() + over[i][places].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of blocks that stand one after the other."""
    heads, at = [], 0
    while at < len(data):
        count, exceptions, width, low = _HEAD.unpack_from(data, at)
        n = -(-count // 64) * width
        heads.append((at + _HEAD.size, n, count, exceptions, width, low))
        at += _HEAD.size + 8 * n + 6 * exceptions
    rows: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    for w in {h[4] for h in heads}:
        some = [i for i, h in enumerate(heads) if h[4] == w]
        groups_of = [-(-heads[i][2] // 64) for i in some]
        words = np.concatenate([np.frombuffer(data, "<u8", heads[i][1], heads[i][0]) for i in some])
        flat = unpack(words.reshape(-1, w), w) if w else np.zeros((sum(groups_of), 64), np.uint64)
        for i, part in zip(some, np.split(flat.astype(np.uint32), np.cumsum(groups_of)[:-1])):
            rows[i] = part.reshape(-1)[: heads[i][2]]
    for row, (at, n, _, exceptions, width, low) in zip(rows, heads):
        if exceptions:
            places = np.frombuffer(data, "<u2", exceptions, at + 8 * n)
            row[places] |= np.frombuffer(data, "<u4", exceptions, at + 8 * n + 2 * exceptions) << np.uint32(width)
        row += np.uint32(low)
    return np.concatenate(rows) if rows else np.zeros(0, np.uint32)


class Writer:
    """One token file. ids come in any number of pieces; each document is closed by document()."""

    def __init__(self, out, percentile: float = 0.9):
        self.out, self.percentile = out, percentile
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.place = self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def _blocks(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        n = len(ids) // least * least
        for block in encode_blocks(ids[:n], self.percentile):
            self.starts.append(self.place)
            self.place += self._put(block)
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def document(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids.astype(np.uint32))
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= 256 * BLOCK:
            self._blocks(BLOCK)

    def close(self) -> int:
        """Bytes of the file."""
        self._blocks(BLOCK)
        if self.waiting:
            self._blocks(self.waiting)
        index = self.place
        self.place += self._put(np.array(self.starts, "<u8").tobytes())
        docs = self.place
        none = np.array([x is None for x in self.docs], np.uint8)
        self.place += self._put(np.array([0 if x is None else x for x in self.docs], "<i8").tobytes() + none.tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.place += self._put(_FOOT.pack(len(self.docs), self.ids, len(self.starts), index, docs, MAGIC))
        return self.place


class Reader:
    """A token file, of which only the footer, the index and the asked blocks are read."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_docs, self.ids, n_blocks, self.index, docs, magic = _FOOT.unpack(self._read(size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.starts = np.append(np.frombuffer(self._read(self.index, 8 * n_blocks), "<u8"), self.index).astype(np.int64)
        table = self._read(docs, 17 * n_docs)
        none = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
        self.docs = [None if x else i for i, x in zip(np.frombuffer(table, "<i8", n_docs).tolist(), none.tolist())]
        self.sizes = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def span(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] of the file, from the blocks that hold them."""
        stop = min(stop, self.ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        ids = decode_blocks(self._read(int(self.starts[first]), int(self.starts[last] - self.starts[first])))
        return ids[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, some: int = 256 * BLOCK) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, place of its first id, ids) in order; about ``some`` ids, or one document, at a time."""
        ends = np.cumsum(self.sizes)
        i = 0
        while i < len(self.docs):
            start = int(ends[i] - self.sizes[i])
            j = max(i + 1, int(np.searchsorted(ends, start + some, side="right")))
            ids = self.span(start, int(ends[j - 1]))
            for k in range(i, j):
                a = int(ends[k] - self.sizes[k])
                yield self.docs[k], a, ids[a - start : int(ends[k]) - start]
            i = j


def _at(path: str):
    return pafs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, percentile: float = 0.9, file_ids: int = 1 << 26) -> DataFrame:
    """Writes docs (doc_id, text) as token files and returns the manifest: part, file, path, docs, ids, bytes and start,
    the number of ids in the files before. ``folder`` is a URI that driver and executors share, by default a new one in
    the cluster's checkpoint folder; files stay there until their owner deletes them."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark)

    def run(rows):
        part, seq = TaskContext.get().partitionId(), 0
        files, base = _at(folder)
        e, writer, out, name = encoder(path), None, None, ""
        done = []

        def finish():
            size = writer.close()
            out.close()
            done.append((part, seq, name, len(writer.docs), writer.ids, size))

        for b in batches(rows):
            texts, ids_of = texts_of(b.column(1)), b.column(0).to_pylist()
            for i, j in groups(texts, 500_000):
                for doc_id, ids in zip(ids_of[i:j], e.encode(texts[i:j])):
                    if writer is None:
                        files.create_dir(base, recursive=True)
                        own = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                        name, out = f"{folder}/{own}", files.open_output_stream(f"{base}/{own}")
                        writer = Writer(out, percentile)
                    writer.document(doc_id, np.append(ids, end_id))
                    if writer.ids >= file_ids:
                        finish()
                        writer, seq = None, seq + 1
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], schema=_MANIFEST)

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    ordered = order.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = cut(ordered.mapInArrow(run, _MANIFEST_ROWS))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """The documents of token files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(rows):
        for b in batches(rows):
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                files, name = _at(path)
                with files.open_input_file(name) as source:
                    held, size = [], 0
                    for doc_id, at, ids in Reader(source).documents():
                        held.append((doc_id, first + at, len(ids), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _DOCS)], schema=_DOCS)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), _DOCS)], schema=_DOCS)

    return manifest.select("path", "start").repartition(F.col("path")).mapInArrow(run, _DOC_ROWS)
