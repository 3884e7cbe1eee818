"""Joins of intervals and boxes by a grid: what overlaps shares a cell, so a page of any size is an equi-join."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.sources.scratch import written

#: Cells along one axis of a group, at most; a coarser grid loses no pair.
MOST_CELLS = 1 << 16

#: Groups in a table, at most, that is broadcast.
MOST_GROUPS = 100_000

Axis = tuple[str, str]


class Large:
    """The groups of which a side has more rows than its number: few such groups are broadcast, and their cells with them.
    ``rest`` tells whether rows may be in other groups or in none."""

    def __init__(self, sides: list[tuple[DataFrame, int]], by: list[str]):
        each = []
        for df, most in sides:
            known = reduce(and_, [F.col(k).isNotNull() for k in by])
            counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
            # all other groups become one row of nulls
            each.append(counts.select(*[F.when(known & (F.col("_n") > most), F.col(k)).alias(k) for k in by]))
        found = written(reduce(DataFrame.unionByName, each).distinct())
        named = F.col(by[0]).isNotNull()
        self.by, self.number, self.rest = by, found.where(named).count(), not found.where(~named).isEmpty()
        self.groups = self.hinted(found.where(named))

    def hinted(self, df: DataFrame) -> DataFrame:
        """df, which has a row for each of the groups."""
        return F.broadcast(df) if self.number <= MOST_GROUPS else df

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of df in other groups or none, and those in large ones."""
        return tuple(df.join(self.groups, self.by, how).select(*df.columns) for how in ("left_anti", "left_semi"))


def cell_sizes(sides: list[tuple[DataFrame, list[Axis]]], by: list[str]) -> DataFrame:
    """The cell's extent along each axis for each group: the mean of the side whose rows are larger, but no more cells in the
    whole group than it has rows. So a grid has about as many entries as rows, also where few large rows meet many small
    ones, and an entry for each cell that a row of uncommon size overlaps."""
    n = len(sides[0][1])
    rows = [df.select(*by, F.lit(k).alias("_side"), *[c for i, (lo, hi) in enumerate(axes) for c in (F.col(lo).cast("double").alias(f"_lo{i}"), F.col(hi).cast("double").alias(f"_hi{i}"))]) for k, (df, axes) in enumerate(sides)]
    every = reduce(DataFrame.unionByName, rows).where(reduce(and_, [F.col(f"_lo{i}") <= F.col(f"_hi{i}") for i in range(n)]))
    side = F.least(F.ceil(F.pow(F.count("*"), F.lit(1.0 / n))), F.lit(MOST_CELLS))
    mean = lambda i: [F.avg(F.when(F.col("_side") == k, F.col(f"_hi{i}") - F.col(f"_lo{i}"))) for k in range(len(sides))]
    size = lambda i: F.greatest(*mean(i), (F.max(f"_hi{i}") - F.min(f"_lo{i}")) / side)
    return every.groupBy(*by).agg(*[F.coalesce(F.nullif(size(i), F.lit(0.0)), F.lit(1.0)).alias(f"_w{i}") for i in range(n)])


def in_cells(df: DataFrame, sizes: DataFrame, by: list[str], axes: list[Axis]) -> DataFrame:
    """A row of df for each cell (_c0, _c1, ...) that it touches; inverted and null extents touch none."""
    out = df.join(sizes, by)
    for i, (lo, hi) in enumerate(axes):
        at = lambda c: F.floor(F.col(c) / F.col(f"_w{i}"))
        out = out.where(F.col(lo) <= F.col(hi)).withColumn(f"_c{i}", F.explode(F.sequence(at(lo), at(hi))))
    return out


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_axes: list[Axis], right_axes: list[Axis], condition: Column | None = None, how: str = "inner", few: int = 64) -> DataFrame:
    """Pairs of rows of a group whose extents meet on every axis (borders count) and that hold the condition.

    ``inner``: each pair once. ``left_semi``: rows of left with such a partner, as often as they have cells with one; the
    search of a cell ends at the first. Column names other than ``by`` differ. Groups of at most ``few`` rows a side are a
    cell of their own: they are joined by group alone, and not shuffled where they are dealt by group already."""
    large = Large([(left, few), (right, few)], by)
    if not large.number:
        return _meeting(left, right, by, [], left_axes, right_axes, condition, how)
    if not large.rest:
        return cell_join(left, right, by, left_axes, right_axes, condition, how, large)
    (a, many_a), (b, many_b) = large.split(left), large.split(right)
    return _meeting(a, b, by, [], left_axes, right_axes, condition, how).unionByName(cell_join(many_a, many_b, by, left_axes, right_axes, condition, how, large))


def cell_join(left: DataFrame, right: DataFrame, by: list[str], left_axes: list[Axis], right_axes: list[Axis], condition: Column | None, how: str, large: Large) -> DataFrame:
    """overlap_join by cells, where all groups are among the large ones: an inner pair is found in the cell of the upper of
    its two lower corners."""
    sizes = large.hinted(cell_sizes([(left, left_axes), (right, right_axes)], by))
    axes, cells = range(len(left_axes)), [f"_c{i}" for i in range(len(left_axes))]
    a = in_cells(left, sizes, by, left_axes)
    b = in_cells(right, sizes, by, right_axes).drop(*[f"_w{i}" for i in axes])
    if how == "inner":
        corner = [F.floor(F.greatest(F.col(lo).cast("double"), F.col(r_lo).cast("double")) / F.col(f"_w{i}")) == F.col(f"_c{i}") for i, ((lo, _), (r_lo, _)) in enumerate(zip(left_axes, right_axes))]
        condition = reduce(and_, corner + ([] if condition is None else [condition]))
    return _meeting(a, b, by, cells, left_axes, right_axes, condition, how).drop(*cells, *[f"_w{i}" for i in axes])


def _meeting(a: DataFrame, b: DataFrame, by: list[str], cells: list[str], left_axes: list[Axis], right_axes: list[Axis], condition: Column | None, how: str) -> DataFrame:
    """Pairs of rows of a group and cell whose extents meet and that hold the condition; inverted and null extents don't."""
    keys = [*by, *cells]
    b = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    a, b = [df.where(reduce(and_, [F.col(lo) <= F.col(hi) for lo, hi in axes])) for df, axes in ((a, left_axes), (b, right_axes))]
    # the size of exploded rows is not known to Spark, which would broadcast them
    b = b.hint("merge")
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    meet = [(F.col(l0) <= F.col(r1)) & (F.col(r0) <= F.col(l1)) for (l0, l1), (r0, r1) in zip(left_axes, right_axes)]
    return a.join(b, reduce(and_, same + meet + ([] if condition is None else [condition])), how).drop(*[f"_r_{k}" for k in keys])
