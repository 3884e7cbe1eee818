"""Exact, repeatable samples, splits and shuffles: a hash of the key orders the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(key: str, seed: int = 42) -> Column:
    """A repeatable order of keys, the same in every engine that has SHA-256."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")), 256)


def _first(df: DataFrame, n: int, key: str, seed: int) -> Column | None:
    """A condition that the first n rows in order of draw, then key, meet; None if n is 0 or less.

    Draws are counted by their first four hex digits; only the rows of the border bucket, one in 65,536, are ordered."""
    if n <= 0:
        return None
    bucket = F.substring(draw(key, seed), 1, 4)
    left, border = n, None
    for r in sorted(df.groupBy(bucket.alias("b")).agg(F.count("*").alias("c")).collect(), key=lambda r: r.b):
        if left <= r.c:
            border = r.b
            break
        left -= r.c
    if border is None:
        return F.lit(True)
    last = df.where(bucket == border).select(draw(key, seed).alias("d"), F.col(key).alias("k")).orderBy("d", "k").limit(left).agg(F.max(F.struct("d", "k")).alias("m")).first().m
    return (bucket < border) | (F.struct(draw(key, seed).alias("d"), F.col(key).alias("k")) <= F.struct(F.lit(last.d).alias("d"), F.lit(last.k).alias("k")))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows. Keys are unique and not null."""
    chosen = _first(df, n, key, seed)
    return df.where(chosen if chosen is not None else F.lit(False))


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """int(rows * fraction) rows."""
    return sample_n(df, int(df.count() * fraction), key, seed)


def split(df: DataFrame, test: int | float, key: str, seed: int = 42, validation: int | float = 0) -> DataFrame:
    """df with split train, test or validation; sizes are numbers of rows or fractions (rounded up), validation of what is
    left without test. Keys are unique."""
    size = lambda x, rows: x if isinstance(x, int) else -int(-(rows * x) // 1)
    rows = df.count()
    n = size(test, rows)
    in_test, in_both = _first(df, n, key, seed), _first(df, n + size(validation, rows - n) if validation else 0, key, seed)
    out = F.lit("train") if in_both is None else F.when(in_both, "validation").otherwise("train")
    return df.withColumn("split", out if in_test is None else F.when(in_test, "test").otherwise(out))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed), key)


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in order, nulls last; each task keeps n."""
    return df.orderBy(F.asc_nulls_last(order)).limit(n)


def last_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows in order, the last one first, nulls last."""
    return df.orderBy(F.desc_nulls_last(order)).limit(n)


def natural_key(column: str) -> list[Column]:
    """ORDER BY expressions: the part before the first number, the number, the whole."""
    return [F.regexp_extract(column, r"^([^0-9]*)", 1), F.coalesce(F.expr(f"try_cast(nullif(regexp_extract({column}, '([0-9]+)', 1), '') as bigint)"), F.lit(-1)), F.col(column)]
