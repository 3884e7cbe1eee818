"""Assets moved to the shard folders that their number asks for, by tasks, so that it can be stopped and run again.

What is to be moved is found by two equi-joins of the rows' paths with a listing of the files, one for the old and one for
the new path, and written as a journal before anything moves. A task moves a file if its old name is there and its new one is
not; a file already moved is left alone. So a task that runs again, or a run after one that was killed half-way, ends in
the same tree. Where both names exist, the old file stays, as it may belong to rows of another table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.text import shard_levels, shard_path
from loomlake.sources.files import located
from loomlake.sources.footers import listing
from loomlake.sources.scratch import written

_DONE = pa.schema([("new_path", pa.string()), ("outcome", pa.string())])


def asset_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files below root, relative to it."""
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root else root.rstrip("/") + "/"
    name = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    return listing(spark, root, "*").select(F.substring(name, len(base) + 1, 1 << 30).alias("path"))


def with_new_paths(rows: DataFrame, levels: int | None = None) -> DataFrame:
    """rows (path, ...) with new_path: the shard folder that the number of rows asks for."""
    depth = F.lit(levels) if levels is not None else shard_levels(F.lit(rows.count()))
    return rows.withColumn("new_path", shard_path(F.regexp_extract("path", r"^(provider=[^/]*/dataset=[^/]*)", 1), F.regexp_extract("path", r"([0-9a-f]{64})", 1), depth, F.regexp_extract("path", r"\.([^./]+)$", 1)))


def planned(spark: SparkSession, rows: DataFrame, root: str, levels: int | None = None) -> DataFrame:
    """One row for each new path, with whether the old and the new file exist; rows with neither are left out."""
    one = with_new_paths(rows.where("path is not null"), levels).dropDuplicates(["new_path"])
    there = written(asset_paths(spark, root))
    old = there.select(F.col("path").alias("_old"), F.lit(True).alias("has_old"))
    new = there.select(F.col("path").alias("_new"), F.lit(True).alias("has_new"))
    out = one.join(old, F.col("path") == F.col("_old"), "left").join(new, F.col("new_path") == F.col("_new"), "left").drop("_old", "_new")
    return out.na.fill(False, ["has_old", "has_new"]).where("has_old or has_new")


def _moved(root: str):
    def run(batches):
        files, base = located(root)
        for b in batches:
            made = []
            for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                source, target = (files.get_file_info(f"{base.rstrip('/')}/{p}") for p in (old, new))
                if target.type.name == "File":
                    made.append((new, "there"))
                elif source.type.name != "File":
                    made.append((new, "missing"))
                else:
                    files.create_dir(target.path.rsplit("/", 1)[0], recursive=True)
                    files.move(source.path, target.path)
                    made.append((new, "moved"))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), _DONE)], schema=_DONE)

    return run


def reshard(spark: SparkSession, rows: DataFrame, root: str, levels: int | None = None) -> DataFrame:
    """rows (path, ...), one for each new path whose file is there when it is done, with path changed to it and outcome:
    moved, there. ``root`` names the assets' folder. The result is written."""
    journal = written(planned(spark, rows, root, levels))
    moves = journal.where("has_old and not has_new and path <> new_path").select("path", "new_path")
    done = written(moves.repartition(F.col("new_path")).mapInArrow(_moved(root), "new_path string, outcome string"))
    out = journal.join(done.withColumnRenamed("new_path", "_n"), F.col("new_path") == F.col("_n"), "left")
    out = out.withColumn("outcome", F.coalesce("outcome", F.lit("there"))).where("outcome <> 'missing'")
    return out.withColumn("path", F.col("new_path")).drop("new_path", "has_old", "has_new", "_n")
