"""Results fetched in chunks, and catalogues as external tables whose new partitions are found by Spark.

A result is ordered and numbered once and written in that order; a chunk is a range of its numbers, which the reader finds
by the statistics of row groups, so the driver holds one chunk and each is read once.

An external table keeps its partitions in the session's catalogue: a search reads those and does not list the others again,
and discovery adds the folders that writers made since.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators.windows import numbered
from loomlake.sources.footers import Catalog
from loomlake.sources.readers import PARTITION_KEYS
from loomlake.sources.scratch import delete, folder


class Chunks:
    """A stored result, read in order of columns, ``size`` rows at a time. Rows that tie come in one order, whichever chunk
    is asked for and however often. Use as a context: its end deletes what is stored."""

    def __init__(self, df: DataFrame, order: str | list, size: int, start: int = 0):
        if size < 1:
            raise ValueError("a chunk has a row at least")
        self.spark, self.size, self.start, self.path = df.sparkSession, size, start, folder(df.sparkSession)
        placed = numbered(df.withColumn("_all", F.lit(0)), "_all", order, "_n").drop("_all")
        placed.repartitionByRange("_n").sortWithinPartitions("_n").write.option("parquet.block.size", 8 << 20).parquet(self.path)
        self.rows = self.spark.read.schema(placed.schema).parquet(self.path)
        self.total = self.rows.count()

    def chunk(self, k: int) -> DataFrame:
        first = k * self.size
        return self.rows.where((F.col("_n") >= first) & (F.col("_n") < first + self.size)).orderBy("_n").drop("_n")

    def __len__(self) -> int:
        return -(-self.total // self.size)

    def __iter__(self) -> Iterator[pd.DataFrame]:
        """From the chunk ``start`` on, so a consumer that stopped can go on."""
        for k in range(self.start, len(self)):
            yield self.chunk(k).toPandas()

    def __enter__(self) -> Chunks:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def concat_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks as one result again, in no order."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def register(spark: SparkSession, root: str, name: str, keys: tuple[str, ...] = PARTITION_KEYS) -> DataFrame:
    """The catalogue below root as the external table ``name``, partitioned by its keys, with the partitions it has now."""
    catalog = Catalog(spark, root, keys)
    have = [k for k in keys if k in catalog.frame.columns]
    columns = ", ".join(f"`{n}` {t}" for n, t in catalog.frame.dtypes)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    quoted = root.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING PARQUET PARTITIONED BY ({', '.join(have)}) LOCATION '{quoted}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def partitions(spark: SparkSession, name: str) -> set[str]:
    """The partitions that the table knows, as key=value/key=value."""
    return {r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}


def discover(spark: SparkSession, name: str, wanted: set[str] = frozenset(), timeout: float = 3600, poll: float = 10) -> set[str]:
    """Adds the partitions that were written since, and returns them. With ``wanted``: looks again every ``poll`` seconds
    until the table knows all of these, for ``timeout`` seconds at most."""
    before, end = partitions(spark, name), time.monotonic() + timeout
    while True:
        spark.catalog.recoverPartitions(name)
        now = partitions(spark, name)
        if not wanted - now:
            return now - before
        if time.monotonic() + poll > end:
            raise TimeoutError(f"{name} lacks {sorted(wanted - now)[:5]} after {timeout} s")
        time.sleep(poll)
