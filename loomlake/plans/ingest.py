"""Uploads: staging, processing with content-hash deduplication, and asset validation.

staging/pending -> staging/processing -> catalog, or staging/failed with the error. Each upload fails by itself.
Lake folders are a shared file system; data are read and written by Spark, directory states by the driver.
"""

from __future__ import annotations

import json
import shutil
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.functions.text import shard_levels, shard_path, suffix
from loomlake.operators.aggregates import integrity
from loomlake.operators.joins import new_assets
from loomlake.operators.search import append_constants, nested_to_json, rename_first, without_reserved
from loomlake.plans.reshard import asset_paths, reshard
from loomlake.sources.files import located, opened
from loomlake.sources.readers import load_source, scan_catalog
from loomlake.sources.sinks import write_catalog, write_report, write_staging

# Column names and suffixes that tell what an upload holds.
IMAGE_COLUMNS = ["image", "image_bytes"]
FILE_COLUMNS = ["file_path", "image_path", "file"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp"]


def detect(df: DataFrame) -> dict:
    """Image and file columns by name and type, and the kind: text, image, files or mixed."""
    types = {f.name: f.dataType for f in df.schema}
    images = [c for c in IMAGE_COLUMNS if isinstance(types.get(c), T.BinaryType)]
    files = [c for c in FILE_COLUMNS if isinstance(types.get(c), T.StringType)]
    for found in (images, files):
        if len(found) > 1:
            raise ValueError(f"more than one asset column: {found}")
    kind = "mixed" if images and files else "image" if images else "text"
    if files and not images:
        first = df.select(suffix(F.col(files[0]))).where(F.col(files[0]).isNotNull()).first()
        kind = "image" if first and first[0] in IMAGE_SUFFIXES else "files"
    return {"image": images, "file": files, "type": kind}


def contents(paths: DataFrame) -> DataFrame:
    """paths (one string column) with _content, the bytes of the file, read by the executors; null if there is none."""
    name = paths.columns[0]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], names=[name, "_content"])

    return paths.mapInArrow(run, f"`{name}` string, _content binary")


class Ingest:
    def __init__(self, spark: SparkSession, root: str, schema, user: str = "user"):
        self.spark, self.root, self.schema, self.user = spark, Path(root), schema, user
        for d in ("staging/pending", "staging/processing", "staging/failed", "catalog", "assets", "collections"):
            (self.root / d).mkdir(parents=True, exist_ok=True)

    def _pending(self, **match) -> list[Path]:
        out = []
        for p in sorted((self.root / "staging/pending").iterdir()):
            meta = p / "upload_metadata.json"
            if meta.exists() and all(json.loads(meta.read_text(encoding="utf-8")).get(k) == v for k, v in match.items()):
                out.append(p)
        return out

    def _stage(self, source, provider: str, dataset: str, task: str, variant: str | None, meta: dict, overwrite: bool, description: str, original_source: str) -> str | None:
        if provider not in self.schema.providers():
            raise ValueError(f"unknown provider: {provider}")
        match = {"provider": provider, "dataset": dataset, "task": task} | ({"variant": variant} if variant else {})
        if old := self._pending(**match):
            if not overwrite:
                return None
            for p in old:
                shutil.rmtree(p)
        df = without_reserved(load_source(self.spark, source), meta)
        df = rename_first(rename_first(df, IMAGE_COLUMNS, "image"), FILE_COLUMNS, "file_path")
        found = detect(df)
        df = append_constants(nested_to_json(df), meta)
        ident = uuid.uuid4().hex[:8]
        metadata = {
            "provider": provider, "dataset": dataset, "task": task, "variant": variant or found["type"], "data_type": "raw" if task == "raw" else "task",
            "dataset_description": description, "original_source": original_source, "has_images": bool(found["image"]), "has_files": bool(found["file"]),
            "total_rows": df.count(), "uploaded_by": self.user, "uploaded_at": datetime.now().isoformat(), "file_id": ident, **meta,
        }
        name = f"{dataset}_{task}_{metadata['variant']}_{ident}_{datetime.now():%Y%m%d_%H%M%S}_{self.user}"
        path = self.root / "staging/pending" / name
        write_staging(df, str(path), metadata)
        return str(path)

    def upload_raw(self, source, provider: str, dataset: str, overwrite: bool = False, description: str = "", original_source: str = "") -> str | None:
        """The staged directory, or None if the same upload is pending and not to be overwritten."""
        return self._stage(source, provider, dataset, "raw", None, {}, overwrite, description, original_source)

    def upload_task(self, source, provider: str, dataset: str, task: str, variant: str, meta: dict, overwrite: bool = False, description: str = "", original_source: str = "") -> str | None:
        ok, why = self.schema.validate(task, meta)
        if not ok:
            raise ValueError(why)
        return self._stage(source, provider, dataset, task, variant, meta, overwrite, description, original_source)

    def status(self) -> dict[str, int]:
        return {d: sum(p.is_dir() for p in (self.root / "staging" / d).iterdir()) for d in ("pending", "processing", "failed")}

    def process_pending(self) -> dict:
        """Process every pending upload; what fails goes to failed with its error."""
        ok, errors = 0, {}
        for p in sorted((self.root / "staging/pending").iterdir()):
            at = self.root / "staging/processing" / p.name
            p.rename(at)
            try:
                self.process_one(at)
                ok += 1
            except Exception as e:
                to = self.root / "staging/failed" / p.name
                at.rename(to)
                (to / "_error.json").write_text(json.dumps({"error": str(e), "at": datetime.now().isoformat()}, ensure_ascii=False), encoding="utf-8")
                errors[p.name] = str(e)
            else:
                shutil.rmtree(at)
        total = ok + len(errors)
        return {"success": ok, "failed": len(errors), "success_rate": f"{ok / total * 100:.1f}%" if total else "0%", "errors": errors}

    def process_one(self, directory: Path) -> str:
        file = Path(directory) / "upload_metadata.json"
        if not file.exists():
            raise ValueError("no upload metadata")
        meta = json.loads(file.read_text(encoding="utf-8"))
        df = self.spark.read.parquet(f"{directory}/data")
        if meta.get("has_images") and "image" in df.columns:
            df = self._store(df, "image", F.lit("jpg"), meta, "")
        if meta.get("has_files") and "file_path" in df.columns:
            df = df.withColumnRenamed("file_path", "_source")
            df = df.join(contents(df.select("_source").where("_source is not null").distinct()), "_source", "left")
            df = self._store(df, "_content", F.regexp_replace(suffix(F.col("_source")), r"^\.", ""), meta, "file_" if meta.get("has_images") else "").drop("_source")
        return write_catalog(df, str(self.root / "catalog"), meta)

    def _store(self, df: DataFrame, column: str, ext, meta: dict, prefix: str) -> DataFrame:
        """path and hash (null where the content is) in place of the content; contents not stored yet are written."""
        base = F.lit(f"provider={meta['provider']}/dataset={meta['dataset']}")
        levels = shard_levels(F.lit(df.count()))
        digest = F.sha2(column, 256)
        out = df.withColumns({f"{prefix}hash": digest, f"{prefix}path": F.when(F.col(column).isNotNull(), shard_path(base, digest, levels, ext))})
        rows = out.select(F.lit(meta["provider"]).alias("provider"), F.lit(meta["dataset"]).alias("dataset"), F.col(f"{prefix}hash").alias("hash"), F.col(f"{prefix}path").alias("path"), F.col(column).alias("content"))
        known = self.stored().where((F.col("provider") == meta["provider"]) & (F.col("dataset") == meta["dataset"]))
        root = str(self.root / "assets")

        def write(parts):
            files, base = located(root)
            for r in parts:
                folder, name = f"{base.rstrip('/')}/{r.path}".rsplit("/", 1)
                files.create_dir(folder, recursive=True)
                tmp = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(tmp) as out:
                    out.write(r.content)
                files.move(tmp, f"{folder}/{name}")  # a task that is run again writes the same file

        new_assets(rows, known).select("path", "content").foreachPartition(write)
        return out.drop(column)

    def stored(self) -> DataFrame:
        """(provider, dataset, hash, path) of the asset files."""
        files = asset_paths(self.spark, str(self.root / "assets"))
        part = lambda k: F.regexp_extract("path", f"{k}=([^/]+)", 1).alias(k)
        return files.select(part("provider"), part("dataset"), F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("hash"), "path")

    def validate_assets(self, fraction: float = 1.0, df: DataFrame | None = None, keep: int = 100, report: str | None = None) -> dict:
        """How many rows' files exist, and the first missing paths; written as a JSON file if ``report`` names one."""
        rows = df if df is not None else scan_catalog(self.spark, str(self.root / "catalog"))
        if fraction < 1:
            rows = rows.where(F.pmod(F.xxhash64("path", "hash"), F.lit(10_000)) < int(fraction * 10_000))
        listing = self.stored().select("path")
        out = integrity(rows, listing).first().asDict()
        missing = rows.where("path is not null and hash is not null").select("path").distinct().join(listing, "path", "left_anti").orderBy("path").limit(keep)
        found = {"timestamp": datetime.now().isoformat(), "summary": out, "missing_files": [r.path for r in missing.collect()]}
        if report:
            write_report(self.spark, report, out, found["missing_files"], found["timestamp"])
        return found

    def reshard(self, df: DataFrame, levels: int | None = None) -> DataFrame:
        """df with the path its row count asks for, its files moved there; rows with neither file go, one row for each path."""
        return reshard(self.spark, df, str(self.root / "assets"), levels).drop("outcome")
