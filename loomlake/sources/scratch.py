"""Tables written between steps, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names; a local one in a session of one JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/loomlake-checkpoints"
    path = f"{base.rstrip('/')}/lake-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table: what was not repeatable, as the places of rows, is fixed, also when executors are lost."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete every folder made here. No plan that reads one may run any more."""
    for path in list(_MADE):
        delete(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean(spark)
