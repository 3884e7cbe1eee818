"""Aggregations over catalogues and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.sources.readers import PARTITION_KEYS


def partitions(df: DataFrame) -> DataFrame:
    return df.groupBy(*PARTITION_KEYS).agg(F.count("*").alias("num_samples")).orderBy(*PARTITION_KEYS)


def level_stats(df: DataFrame) -> DataFrame:
    """How many partitions each value of each level has, all levels in one pass over the partitions."""
    parts = df.groupBy(*PARTITION_KEYS).agg(F.count("*").alias("num_samples"))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("value")) for k in PARTITION_KEYS])).alias("x")
    return parts.select(level).groupBy("x.level", "x.value").agg(F.count("*").alias("num_partitions"))


def level_matrix(df: DataFrame, row: str, column: str, values: list | None = None) -> DataFrame:
    """Partitions for each pair of values of two levels; "-" where there are none."""
    parts = df.select(*PARTITION_KEYS).distinct()
    out = parts.groupBy(row).pivot(column, values).count() if values else parts.groupBy(row).pivot(column).count()
    return out.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(c) for c in out.columns if c != row])


def top_values(df: DataFrame, column: str, order: str, k: int = 3) -> DataFrame:
    """The k most frequent values; of equal counts the one seen first."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def mode_by(df: DataFrame, group: str, column: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equal counts the one seen first."""
    counts = df.groupBy(group, column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.groupBy(group).agg(F.max_by(column, F.struct("n", -F.col("first_seen"))).alias("mode"), F.max("n").alias("n"))


def integrity(checked: DataFrame, listing: DataFrame) -> DataFrame:
    """checked (path, hash) against the files that exist: rows without path or hash are not checked."""
    rows = checked.where("path is not null and hash is not null")
    flags = rows.join(listing.select("path").distinct().withColumn("found", F.lit(1)), "path", "left")
    total, missing = F.count("*"), F.count(F.when(F.col("found").isNull(), 1))
    rate = F.when(total == 0, F.lit(0.0)).otherwise(F.round((total - missing) / total * 100, 2))
    return flags.agg(total.alias("checked"), missing.alias("missing"), rate.alias("integrity_rate"))


def success_rate(ok: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit("0%")).otherwise(F.format_string("%.1f%%", ok / total * 100))


def grouped_lists(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key with the lists of the other columns, in order (several turns on one image)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(key).agg(rows.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def bbox_union(df: DataFrame, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def quantiles(df: DataFrame, column: str, qs=(0.9, 0.95, 0.98, 0.99, 0.999, 1.0)) -> DataFrame:
    """Exact, interpolated."""
    return df.agg(F.percentile(column, F.array(*map(F.lit, qs))).alias("q")).select(F.posexplode("q").alias("i", "v")).select(F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"), F.col("v").alias("value"))


def unique_counts(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.countDistinct(column).alias("distinct"), (F.count("*") == F.countDistinct(column)).alias("is_unique"))


def collapse_multi(df: DataFrame, group: str, column: str, multi: str = "multi") -> DataFrame:
    """The only value of a group, or the word for several."""
    return df.groupBy(group).agg(F.when(F.countDistinct(column) > 1, F.lit(multi)).otherwise(F.max(column)).alias(column))


def single_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys with one row; groups are counted, not gathered."""
    return df.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def middles(df: DataFrame, by: str, column: str) -> DataFrame:
    """Exact median and mean of a column in each group."""
    return df.groupBy(by).agg(F.median(column).alias("median"), F.avg(column).alias("mean"))


def _columns_of(group, v, n, k: int, steps: int, least: int):
    """The column of each coordinate of many groups at once: group ascends from 0, v ascends in a group, n counts rows."""
    import numpy as np

    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low, high = v[first], v[np.r_[first[1:], len(v)] - 1]
    with np.errstate(invalid="ignore", over="ignore"):
        wide = np.isfinite(high - low) & (high > low)
    c = np.full((len(first), k), np.inf)
    c[:, 0] = low
    if wide.any():
        c[wide] = np.linspace(low[wide], high[wide], k, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = np.inf
        c.sort(axis=1)
    at = np.full(len(v), -1, np.int64)
    rows, g, todo = np.arange(len(v)), group, np.arange(len(first))
    for _ in range(steps):
        # ties go to the left centre, as coordinates and centres ascend
        mine, x, w = c[todo], v[rows], n[rows]
        new = (x[:, None] > ((mine[:, :-1] + mine[:, 1:]) / 2)[g]).sum(axis=1)
        moved = np.zeros(len(todo), bool)
        moved[g[new != at[rows]]] = True
        at[rows] = new
        if not moved.any():
            break
        cell, size = g * k + new, len(todo) * k
        sums = np.bincount(cell, w, size).reshape(-1, k)
        mine = np.where(sums > 0, np.bincount(cell, w * x, size).reshape(-1, k) / np.maximum(sums, 1), mine)
        c[todo[moved]] = mine[moved]
        # groups whose coordinates stayed are done
        stay = moved[g]
        rows, g, todo = rows[stay], (np.cumsum(moved) - 1)[g[stay]], todo[moved]
    sums = np.bincount(group * k + at, n, len(first) * k).reshape(-1, k)
    filled = sums > 0
    number = np.cumsum(filled, axis=1) - 1
    to = number.copy()
    for i in range(k) if least > 1 else []:
        best, score = number[:, i].copy(), np.full((len(first), 2), -np.inf)
        for j in range(k):
            own = np.stack([sums[:, j], -np.abs(number[:, j] - number[:, i])], axis=1)
            better = filled[:, j] & ((own[:, 0] > score[:, 0]) | (own[:, 0] == score[:, 0]) & (own[:, 1] > score[:, 1]))
            best[better], score[better] = number[better, j], own[better]
        to[:, i] = np.where(sums[:, i] < least, best, number[:, i])
    return to[group, at]


def column_centres(df: DataFrame, group: str, x: str, k: int = 3, steps: int = 300, least: int = 1) -> DataFrame:
    """df with column: k-means of one coordinate in each group (a page), seeded evenly over its range, until no coordinate
    changes its centre. Columns are numbered left to right; one of fewer than ``least`` rows goes to the one of most rows,
    the nearest of those that tie. A group is clustered by its distinct coordinates and how often each occurs, so rows
    are not gathered; null coordinates have no column. Groups follow each other in sorted partitions, and those of a batch
    are clustered together, as most pages are small."""
    import numpy as np
    import pyarrow as pa

    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(x).alias("_x")).agg(F.count("*").cast("double").alias("_n"))
    counts = counts.withColumn("_v", F.col("_x").cast("double")).withColumn("_k", F.row_number().over(Window.partitionBy("_g").orderBy("_x")) == 1)

    def cluster(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        v, n, new = (t.column(c).to_numpy() for c in ("_v", "_n", "_k"))
        found = _columns_of(np.cumsum(new) - 1, v, n, k, steps, least)
        return t.select(["_g", "_x"]).append_column("column", pa.array(found, pa.int32()))

    def run(batches):
        held = []
        for b in batches:
            last = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False)) if b.num_rows else []
            if len(last) and (held or last[-1]):  # the last group may go on in the next batch
                ready = [*held, b.slice(0, last[-1])]
                if sum(r.num_rows for r in ready):
                    yield from cluster(ready).to_batches()
                held = [b.slice(last[-1])]
            elif b.num_rows:
                held.append(b)
        if held:
            yield from cluster(held).to_batches()

    schema = counts.select("_g", "_x").schema.add("column", "integer")
    found = counts.select("_g", "_x", "_n", "_k", "_v").mapInArrow(run, schema)
    return df.join(found, F.col(group).eqNullSafe(F.col("_g")) & (F.col(x) == F.col("_x")), "left").drop("_g", "_x")
