"""Sinks: catalogue partitions, staging uploads, downloads, JSON lines and reports."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.sources.readers import PARTITION_KEYS


def write_catalog(df: DataFrame, root: str, metadata: dict) -> str:
    """Overwrite one partition; its metadata stands beside the data."""
    out = "/".join([root.rstrip("/"), *(f"{k}={metadata[k]}" for k in PARTITION_KEYS)])
    df.drop(*PARTITION_KEYS).write.mode("overwrite").parquet(out)
    write_json(df.sparkSession, f"{out}/_metadata.json", metadata)
    return out


def write_catalog_partitions(df: DataFrame, root: str) -> None:
    """Overwrite just the partitions that df has rows of. Spark splits the large ones among tasks by their measured size, and
    each of these writes a file of its own."""
    df.hint("rebalance", *PARTITION_KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION_KEYS).parquet(root)


def write_json(spark, path: str, value) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def write_staging(df: DataFrame, path: str, metadata: dict) -> None:
    """An upload: data and its metadata. Nothing stays if either fails."""
    try:
        df.write.parquet(f"{path}/data")
        (Path(path) / "upload_metadata.json").write_text(json.dumps(metadata, ensure_ascii=False, indent=2), encoding="utf-8")
    except Exception:
        shutil.rmtree(path, ignore_errors=True)
        raise


def write_parquet_file(df: DataFrame, path: str) -> str:
    """A single file for hand-over; the suffix is forced."""
    path = path if path.endswith(".parquet") else f"{path}.parquet"
    tmp = f"{path}.tmp"
    df.coalesce(1).write.mode("overwrite").parquet(tmp)
    part = next(Path(tmp).glob("part-*.parquet"))
    part.replace(path)
    shutil.rmtree(tmp)
    return path


def download(df: DataFrame, path: str, format: str = "auto") -> str:
    """auto: a .parquet suffix is one file, anything else a dataset directory."""
    if format == "auto":
        format = "parquet" if path.endswith(".parquet") else "dataset"
    if format == "parquet":
        return write_parquet_file(df, path)
    if format == "dataset":
        df.write.mode("overwrite").parquet(path)
        return path
    raise ValueError(f"unknown format: {format}")


def write_chat_jsonl(df: DataFrame, path: str) -> None:
    """One {"messages", "images"} object a line."""
    df.select(F.to_json(F.struct("messages", "images")).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_report(spark, path: str, summary: dict, missing: list[str], now: str) -> None:
    """A validation report: time, summary and the missing files that are listed."""
    names = ("total_items", "checked_items", "missing_count", "integrity_rate")
    write_json(spark, path, {"timestamp": now, "summary": {k: summary.get(k, 0) for k in names}, "missing_files": missing})
