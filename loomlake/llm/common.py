"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch. Texts differ in length by orders of magnitude, so batches stay short.
BATCH_ROWS = 512


def tune(spark: SparkSession) -> None:
    """Short batches of rows: a worker holds one Arrow batch of whole texts at a time, a JVM task one of Parquet."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session in one JVM can do with a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/loomlake-checkpoints"
    return f"{base.rstrip('/')}/loomlake-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage, safe when executors are lost."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so when the JVM has collected them."""
    gc.collect()
    spark._jvm.System.gc()


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts as one byte array and the offsets of each (one more than parts)."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span, equal for equal bytes, from one prefix sum."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    # each byte takes an unrelated 64-bit value, so that zero bytes and sums of bytes tell spans apart; all in one array
    np.take(_BYTE_VALUES, data, out=prefix[1:], mode="clip")
    prefix[1:] *= up[: len(data)]
    np.cumsum(prefix[1:], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out, out=out)


def give_back() -> None:
    """Return freed memory to the system. Workers live on between tasks, and the next stage runs beside their heaps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows. A task gives back what the one before left, and its own memory behind the last batch."""
    give_back()
    try:
        for b in rows:
            if b.num_rows:
                yield b
    finally:
        give_back()
