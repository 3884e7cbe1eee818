"""Readers: partitioned catalogues, files of several formats, and dispatch on what a source is."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION_KEYS = ("provider", "dataset", "task", "variant")


def _common_type(types: list[T.DataType]) -> T.DataType:
    """The type that holds all of them: numbers widen to double, anything else differing becomes a string."""
    if len(set(types)) == 1:
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return T.StringType()


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns a frame lacks are null, and types that differ are widened."""
    types: dict[str, list[T.DataType]] = defaultdict(list)
    for df in frames:
        for f in df.schema:
            types[f.name].append(f.dataType)
    target = {n: _common_type(t) for n, t in types.items()}

    def fit(df: DataFrame) -> DataFrame:
        cast = lambda f: F.to_json(f.name) if isinstance(target[f.name], T.StringType) and isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast(target[f.name])
        return df.select(*[F.col(f"`{f.name}`") if f.dataType == target[f.name] else cast(f).alias(f.name) for f in df.schema])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(fit, frames))


def scan_catalog(spark: SparkSession, root: str, filename: bool = False) -> DataFrame:
    """Hive-partitioned Parquet, union by name. Files whose columns the reader can widen to one type are one scan, so
    directories are pruned by filters on the partition keys and columns by projections. Partition values are strings."""
    from loomlake.sources.footers import Catalog

    return Catalog(spark, root, PARTITION_KEYS, filename).frame


def scan_glob(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet files below root as one table, partition directories read as columns."""
    return scan_catalog(spark, root)


def read_json_documents(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """One JSON document a file; gzip by extension."""
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)).csv(path, header=True)


def parse_key_values(line) -> F.Column:
    """`k=v k2=v2` -> map of key to its values in order; only the first = of a word divides it."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: F.instr(w, "=") > 0)
    key = lambda w: F.substring_index(w, "=", 1)
    value = lambda w: F.regexp_replace(w, r"^[^=]*=", "")
    keys = F.array_distinct(F.transform(words, key))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(words, lambda w: key(w) == k), value))))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Lines of key=value words; blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(parse_key_values(F.col("value")).alias("fields"))


def read_splits(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Several splits as one table with a split column; missing splits are skipped."""
    frames = []
    for split, path in files.items():
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath):
            frames.append(spark.read.parquet(path).withColumn("split", F.lit(split)))
    if not frames:
        raise FileNotFoundError("no split has files")
    return union_by_name(frames)


def _ipc(content: bytes):
    import pyarrow as pa

    try:
        return pa.ipc.open_file(content).read_all()
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(content).read_all()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, one or a folder of them (a dataset folder), read by the executors. All have the first one's schema."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").load(path).select("content")
    first = files.limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no Arrow file: {path}")
    schema = spark.createDataFrame(_ipc(bytes(first[0].content)).slice(0, 1)).schema

    def run(batches):
        for b in batches:
            for content in b.column(0):
                yield from _ipc(content.as_buffer().to_pybytes()).to_batches()

    return files.mapInArrow(run, schema)


def extract_zips(folder: str, to: str, name_part: str = "") -> list[str]:
    """Archives below a folder whose name holds name_part, each into its own folder, by the executors. Faulty archives, and
    members that would lie outside, are an error, raised when the others are written."""
    from loomlake.sources import archives

    done = archives.extract_zips(SparkSession.getActiveSession(), Path(folder).resolve().as_uri(), Path(to).resolve().as_uri(), name_part)
    if bad := done.where("error is not null").orderBy("archive", "name").first():
        raise ValueError(f"{bad.archive}: {bad.name}: {bad.error}")
    stem = F.regexp_extract("archive", r"([^/]*)\.[^./]*$", 1).alias("stem")
    return [str(Path(to).resolve() / r.stem) for r in done.select(stem).distinct().orderBy("stem").collect()]


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of an annotation file."""
    doc = read_json_documents(spark, path)
    star = lambda k: "x.*" if isinstance(doc.schema[k].dataType.elementType, T.StructType) else "x"
    return tuple(doc.select(F.explode(k).alias("x")).select(star(k)) for k in ("images", "annotations", "categories"))


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all files below root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content", "length")


def load_source(spark: SparkSession, source) -> DataFrame:
    """A DataFrame, a pandas frame, an Arrow table, a directory of Parquet, or a .parquet file."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(source, DataFrame):
        return source
    if isinstance(source, (pd.DataFrame, pa.Table)):
        return spark.createDataFrame(source)
    if isinstance(source, (str, Path)):
        path = str(source)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(jpath):
            raise FileNotFoundError(path)
        if fs.getFileStatus(jpath).isDirectory() or path.endswith(".parquet"):
            return spark.read.parquet(path)
        raise ValueError(f"not a Parquet file or directory: {path}")
    raise TypeError(f"no source of type {type(source).__name__}")
