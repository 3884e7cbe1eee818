"""The main interface: upload, process, build, search, download, collect."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.text import absolute_path
from loomlake.operators import aggregates, search
from loomlake.plans.collections import Collections
from loomlake.plans.ingest import Ingest
from loomlake.plans.jobs import JobRegistry
from loomlake.plans.schema import SchemaRegistry
from loomlake.sources import sinks
from loomlake.sources.footers import Catalog, listing
from loomlake.sources.readers import PARTITION_KEYS, load_source, read_assets


class Lake:
    def __init__(self, spark: SparkSession, root: str, user: str = "user"):
        self.spark, self.root, self.user = spark, Path(root), user
        self.schema = SchemaRegistry(str(self.root / "config/schema.yaml"))
        self.ingest = Ingest(spark, root, self.schema, user)
        self.collections = Collections(spark, str(self.root / "collections"), user)
        self.jobs = JobRegistry()
        self._catalog: DataFrame | None = None
        self._built: float | None = None

    def upload_raw(self, *args, **kw):
        return self.ingest.upload_raw(*args, **kw)

    def upload_task(self, *args, **kw):
        return self.ingest.upload_task(*args, **kw)

    def reupload(self, df: DataFrame, task: str, variant: str, meta: dict | None = None, order: str = "path") -> dict[str, str | None]:
        """Each dataset of df staged as an upload of its own, under the provider, language and source of its first row in
        order; what was pending of it is replaced. The rows are written once, by dataset, and each upload reads its own."""
        from loomlake.sources.scratch import folder

        first = df.groupBy("dataset").agg(F.min_by(F.struct("provider", "lang", "src"), F.struct(F.col(order), "provider", "lang", "src")).alias("r"))
        path = folder(self.spark)
        df.write.partitionBy("dataset").parquet(path)
        rows, out = self.spark.read.schema(df.schema).parquet(path), {}
        for name, r in first.orderBy("dataset").collect():
            own = rows.where(F.col("dataset") == name).drop("dataset", "provider", "lang", "src", "task", "variant")
            out[name] = self.upload_task(own, r.provider, name, task, variant, {"lang": r.lang, "src": r.src} | (meta or {}), overwrite=True)
        return out

    def trigger_processing(self, background: bool = True) -> str:
        return self.jobs.start("process", self.ingest.process_pending, exclusive=True, background=background)

    def request_asset_validation(self, fraction: float = 1.0, df: DataFrame | None = None, background: bool = True) -> str:
        return self.jobs.start("validate", lambda: self.ingest.validate_assets(fraction, df), background=background)

    def wait_for_job(self, ident: str, timeout: float = 3600) -> dict:
        return self.jobs.wait(ident, timeout)

    def _files(self):
        """(newest change in seconds, bytes) of the catalogue's files, from Spark's listing."""
        r = listing(self.spark, str(self.root / "catalog")).agg(F.unix_micros(F.max("modificationTime")).alias("newest"), F.sum("length").alias("size")).first()
        return (r.newest or 0) / 1e6, r.size or 0

    def _newest(self) -> float:
        return self._files()[0]

    def is_stale(self) -> bool:
        return self._built is None or self._newest() > self._built

    def build(self, view: str = "catalog") -> DataFrame:
        """Read the catalogue's present state and register it for SQL."""
        self._built = self._newest()
        self._footers = Catalog(self.spark, str(self.root / "catalog"), PARTITION_KEYS)
        self._catalog = self._footers.frame
        self._catalog.createOrReplaceTempView(view)
        return self._catalog

    @property
    def catalog(self) -> DataFrame:
        return self._catalog if self._catalog is not None and not self.is_stale() else self.build()

    def sql(self, query: str) -> DataFrame:
        self.catalog
        return self.spark.sql(query)

    def partitions(self) -> DataFrame:
        return aggregates.partitions(self.catalog)

    def info(self) -> dict:
        return {"total_rows": self.catalog.count(), "partitions": self.partitions().count(), "stale": self.is_stale(), "built_at": datetime.fromtimestamp(self._built or 0).isoformat(), "size": self._files()[1]}

    def search(self, providers=None, datasets=None, tasks=None, variants=None, text_search: dict | None = None, limit: int | None = None, partitions_too: bool = False) -> DataFrame:
        catalog = self.catalog
        if not text_search:  # null columns are known from footers
            return self._footers.search(limit, provider=providers, dataset=datasets, task=tasks, variant=variants)
        return search.search(catalog, text_search, limit, partitions_too, provider=providers, dataset=datasets, task=tasks, variant=variants)

    def to_dataset(self, df: DataFrame, include_images: bool = False, check_paths: bool = False, absolute: bool = True) -> DataFrame:
        """Rows with absolute paths; with their files' contents if asked; without rows whose file is gone if checked."""
        if "path" not in df.columns:
            return df
        if check_paths:
            df = search.existing_paths(df, self.ingest.stored())
        if include_images:
            files = read_assets(self.spark, str(self.root / "assets")).select(F.regexp_extract("path", r"assets/(.*)$", 1).alias("path"), F.col("content").alias("image"))
            df = df.join(files, "path", "left").where("image is not null")
        return df.withColumn("path", absolute_path(F.col("path"), str(self.root / "assets"))) if absolute else df

    def download(self, df: DataFrame, path: str, format: str = "auto", include_images: bool = False) -> str:
        return sinks.download(self.to_dataset(df, include_images), path, format)

    def import_collection(self, source, name: str, version: str | None = None, description: str = "") -> str:
        return self.collections.save(load_source(self.spark, source), name, version, description)
