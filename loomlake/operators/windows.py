"""Order-dependent operators. Each takes an explicit order column: rows have none of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.sources.scratch import written


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key (null orders come first), combined before the shuffle."""
    whole = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order))
    return df.groupBy(*keys).agg(whole.alias("_r")).select("_r.*")


def _columns(names: str | Column | list) -> list[Column]:
    return [F.col(f"`{c}`") if isinstance(c, str) else c for c in (names if isinstance(names, list) else [names])]


def numbered(df: DataFrame, group: str | list[str], order: str | Column | list, name: str) -> DataFrame:
    """df with the place, from 0, of each row of a group; rows that tie in order have places as they come.

    Rows are ordered once, by ranges of (group, order), so a group that holds most rows is many tasks, and written with
    their range and place in it. All that follows reads that table, so a task that runs again, a projection or what df does
    before cannot give other places. The join on (group, range) adds what the ranges before hold of a group; it is as
    large as there are groups and ranges, and Spark broadcasts it if it measures it to be small."""
    by = _columns(group)
    keys = by + _columns(order)
    placed = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    ids = [f"_g{i}" for i in range(len(by))]
    sizes = placed.groupBy(*[c.alias(i) for c, i in zip(by, ids)], F.shiftright("_at", 33).alias("_q")).agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    before = F.sum("_c").over(Window.partitionBy(*ids).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_c")
    same = [c.eqNullSafe(F.col(i)) for c, i in zip(by, ids)] + [F.col("_p") == F.col("_q")]
    joined = placed.withColumn("_p", F.shiftright("_at", 33)).join(sizes, same)
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_p", "_q", "_first", "_before", *ids)


def all_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once. Keys are counted before they are shuffled."""
    counts = df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).where("_n > 1")
    return df.join(counts, [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")


def distinct_assets(df: DataFrame) -> DataFrame:
    return df.select("hash", "path").dropna().dropDuplicates()


def element_index(df: DataFrame, image: str, position: str, precedence: str) -> DataFrame:
    """idx is the precedence if any element of the image has one other than zero, else the 1-based position."""
    w = Window.partitionBy(image)
    ordered = F.max(F.coalesce(F.col(precedence), F.lit(0)) != 0).over(w)
    return df.withColumn("idx", F.when(ordered, F.col(precedence)).otherwise(F.row_number().over(w.orderBy(position))))


def reading_order(boxes: DataFrame, page: str = "page", n_col: int = 3) -> DataFrame:
    """boxes (page, box_id, x1, y1, x2, y2, has_neighbour): boxes alone on their line come first, downwards; the others
    by equal-width columns, left to right, and downwards in each."""
    w = Window.partitionBy(page)
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inner = F.when(F.col("has_neighbour"), F.col("_x"))
    spread = boxes.withColumns({"_x": x, "_y": y}).withColumns({"_low": F.min(inner).over(w), "_high": F.max(inner).over(w)})
    placed = F.least(F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * n_col), F.lit(n_col - 1))
    column = F.when(~F.col("has_neighbour"), -1).when(F.col("_high") == F.col("_low"), n_col - 1).otherwise(placed)
    ordered = spread.withColumn("col", column.cast("int")).withColumn("reading_order", F.row_number().over(w.orderBy("col", "_y", "box_id")))
    return ordered.drop("_x", "_y", "_low", "_high")


def line_order(words: DataFrame, page: str = "page") -> DataFrame:
    """words (page, word_id, x1, y1, x2, y2): lines of words that overlap in height, downwards, and the place in a line."""
    down = Window.partitionBy(page).orderBy("y1", "word_id")
    reach = F.max("y2").over(down.rowsBetween(Window.unboundedPreceding, -1))
    middle = (F.col("y1") + F.col("y2")) / 2
    new = F.when(reach.isNull() | (middle >= reach), 1).otherwise(0)
    lined = words.withColumn("_new", new).withColumn("line", F.sum("_new").over(down)).drop("_new")
    return lined.withColumn("place", F.row_number().over(Window.partitionBy(page, "line").orderBy("x1", "word_id")))


def batch_names(df: DataFrame, group: str, order: str, size: int = 1000) -> DataFrame:
    """Folder batch_NNNN of at most `size` files, and file_NNNNNN."""
    return numbered(df, group, order, "_n").withColumns({"batch": F.format_string("batch_%04d", F.floor(F.col("_n") / size)), "file": F.format_string("file_%06d", "_n")}).drop("_n")


def fixed_groups(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Groups of exactly `size` rows; what is left over is dropped."""
    counts = df.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("_c"))
    out = numbered(df, by, order, "_n").withColumn("grp", F.floor(F.col("_n") / size))
    return out.join(counts, F.col(by).eqNullSafe(F.col("_b"))).where((F.col("grp") + 1) * size <= F.col("_c")).drop("_n", "_b", "_c")


def next_version(df: DataFrame, version: str = "version", prefix: str = "v") -> DataFrame:
    n = F.max(F.expr(f"try_cast(nullif(regexp_extract({version}, '^{prefix}([0-9]+)$', 1), '') as int)"))
    return df.agg(F.concat(F.lit(prefix), F.coalesce(n, F.lit(0)) + 1).alias("next_version"))
