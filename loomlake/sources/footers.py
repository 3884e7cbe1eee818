"""What Parquet footers say of a catalogue, read by the executors: rows, schemas and numbers of values.

No data page is decoded, and no file is opened by the driver. Files are opened through the file system that their URI
names, with pyarrow; of each only the footer is read.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlake.sources import scratch
from loomlake.sources.files import opened

_SCHEMA = pa.schema([("path", pa.string()), ("rows", pa.int64()), ("name", pa.string()), ("place", pa.int32()), ("type", pa.string()), ("filled", pa.int64())])
_ROWS = "path string, rows long, name string, place int, type string, filled long"
#: Types that Spark's Parquet reader widens by itself: what is stored, what may be asked for.
_WIDENED = {("byte", "long"), ("short", "long"), ("integer", "long"), ("integer", "double"), ("float", "double"), ("short", "double"), ("byte", "double")}


def listing(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """(path, length, modificationTime) of the files below root, in any file system that Spark reads. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


def _leaves(kind: pa.DataType) -> int:
    return sum(_leaves(kind.field(i).type) for i in range(kind.num_fields)) if pa.types.is_nested(kind) else 1


def _columns(metadata, schema: pa.Schema):
    """(name, type, values) of each column. values: how many are not null; None where the footer does not say."""
    from pyspark.sql.pandas.types import from_arrow_type

    own = (metadata.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    types = {f["name"]: json.dumps(f["type"], sort_keys=True) for f in json.loads(own)["fields"]} if own else {}
    at = 0
    for field in schema:
        n, nested = _leaves(field.type), pa.types.is_nested(field.type)
        counts = []
        for leaf in range(at, at + n):
            parts = [metadata.row_group(g).column(leaf) for g in range(metadata.num_row_groups)]
            known = all(p.statistics is not None and p.statistics.has_null_count for p in parts)
            counts.append(sum(p.num_values - p.statistics.null_count for p in parts) if known else None)
        at += n
        filled = max((c for c in counts if c is not None), default=None)
        if None in counts and not filled or nested and not filled:
            filled = None  # an empty list or struct is a value without leaves
        yield field.name, types.get(field.name) or json.dumps(json.loads(from_arrow_type(field.type).json()), sort_keys=True), filled


def footers(files: DataFrame, per_task: int = 256) -> DataFrame:
    """files (path) -> one row for each file and column: path, rows, name, place, type (JSON), filled. A file without
    columns has one row with a null name."""

    def run(batches):
        import pyarrow.parquet as pq

        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                with opened(path) as f:
                    file = pq.ParquetFile(f)
                    found = list(_columns(file.metadata, file.schema_arrow)) or [(None, None, None)]
                    rows += [(path, file.metadata.num_rows, n, i, t, v) for i, (n, t, v) in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    paths = files.select("path")
    tasks = max(1, min(-(-paths.count() // per_task), 4096), min(paths.sparkSession.sparkContext.defaultParallelism, 8))
    return paths.repartition(tasks).mapInArrow(run, _ROWS)


class Catalog:
    """A catalogue whose schema and null columns come from footers. The footers are written once as a table, so opening it
    again and every search read that; Spark's scan alone reads data."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], filename: bool = False):
        from loomlake.sources.readers import _common_type

        self.spark, self.root, self.keys, self.filename = spark, root.rstrip("/"), keys, filename
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(root)
        # folder names as Spark writes them: special characters as %XX
        value = lambda k: F.url_decode(F.replace(F.regexp_extract("path", f"/{k}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))).alias(k)
        self.stats = scratch.written(footers(listing(spark, root)).select("*", *[value(k) for k in keys]))
        self.types: dict[str, list[T.DataType]] = {}
        for r in self.stats.where("name is not null").groupBy("name").agg(F.sort_array(F.collect_set("type")).alias("types"), F.min(F.struct("path", "place")).alias("first")).orderBy("first").collect():
            self.types[r.name] = [T._parse_datatype_json_value(json.loads(t)) for t in r.types]
        self.empty = self.stats.limit(1).count() == 0
        if self.empty:
            raise FileNotFoundError(f"no Parquet files under {root}")
        self.target = {n: _common_type(t) for n, t in self.types.items() if n not in keys}
        self.frame = self._frame()

    def _scan(self, types: dict[str, T.DataType], *paths: str) -> DataFrame:
        fields = [T.StructField(n, t) for n, t in types.items()] + [T.StructField(k, T.StringType()) for k in self.keys if self._has(k)]
        df = self.spark.read.option("basePath", self.root).schema(T.StructType(fields)).parquet(*paths)
        return df.withColumn("filename", F.col("_metadata.file_path")) if self.filename else df

    def _has(self, key: str) -> bool:
        if not hasattr(self, "_present"):
            row = self.stats.agg(*[F.max(F.col(k) != "").alias(k) for k in self.keys]).first()
            self._present = {k for k in self.keys if row[k]}
        return key in self._present

    def _frame(self) -> DataFrame:
        """One scan, if the reader widens what differs; else one for each set of types that cannot be read as one."""
        from loomlake.sources.readers import union_by_name

        hard = [n for n, t in self.target.items() if any(x != t and (x.typeName(), t.typeName()) not in _WIDENED for x in self.types[n])]
        order = [*self.target, *(["filename"] if self.filename else []), *[k for k in self.keys if self._has(k)]]
        if not hard:
            return self._scan(self.target, self.root).select(*[F.col(f"`{n}`") for n in order])
        one = self.stats.groupBy("path").agg(F.sort_array(F.collect_list(F.when(F.col("name").isin(hard), F.struct("name", "type")))).alias("has"))
        frames = []
        for r in one.groupBy("has").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("has").collect():
            own = {h["name"]: T._parse_datatype_json_value(json.loads(h["type"])) for h in r.has}
            frames.append(self._scan({n: own.get(n, t) for n, t in self.target.items() if n in own or n not in hard}, *r.paths))
        return union_by_name(frames).select(*[F.col(f"`{n}`") for n in order])

    def present(self, **keys) -> list[str]:
        """The columns with a value in some row of the partitions that keys name, in schema order, by footers alone. Only a
        column of which no footer tells is read."""
        from loomlake.operators.search import partition_filter

        chosen = partition_filter(self.stats, **keys).where("rows > 0")
        told = {r.name: r for r in chosen.groupBy("name").agg(F.max(F.coalesce("filled", F.lit(0))).alias("most"), F.max(F.col("filled").isNull()).alias("unknown")).collect()}
        if not told:
            return []
        found = {n for n, r in told.items() if r.most > 0}
        if open_ := [n for n, r in told.items() if n is not None and r.unknown and not r.most]:
            counts = partition_filter(self.frame, **keys).agg(*[F.count(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(open_)]).first()
            found |= {n for n, c in zip(open_, counts) if c}
        return [c for c in self.frame.columns if c in found or c in self.keys or c == "filename"]

    def search(self, limit: int | None = None, **keys) -> DataFrame:
        from loomlake.operators.search import partition_filter

        out = partition_filter(self.frame, **keys).select(*[F.col(f"`{c}`") for c in self.present(**keys)])
        return out.limit(limit) if limit else out
