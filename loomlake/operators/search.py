"""Search over a catalogue: partition filters, null-column pruning, text and JSON-path predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.sources.readers import PARTITION_KEYS

#: Columns that uploads must not bring along: they are set when an upload is staged.
RESERVED = ("provider", "dataset", "task", "variant", "uploaded_by", "uploaded_at", "file_id", "data_type")


def _values(v) -> list[str]:
    return [x for x in ([v] if isinstance(v, str) else v or []) if x]


def partition_filter(df: DataFrame, **keys) -> DataFrame:
    """AND over keys of OR over values; nothing given is no condition. Reaches the scan as partition pruning."""
    for k, v in keys.items():
        if k not in PARTITION_KEYS:
            raise ValueError(f"not a partition key: {k}")
        if vals := _values(v):
            df = df.where(F.col(k).isin(vals))
    return df


def equal_all(df: DataFrame, conditions: dict) -> DataFrame:
    return df.where(reduce(and_, [F.col(k) == v for k, v in conditions.items()], F.lit(True)))


def present_columns(df: DataFrame) -> list[str]:
    """Columns with a value in some row, in schema order; one pass for all of them."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for c, n in zip(df.columns, row) if n]


def prune_null_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in present_columns(df)])


def search_partitions(df: DataFrame, limit: int | None = None, **keys) -> DataFrame:
    out = prune_null_columns(partition_filter(df, **keys))
    return out.limit(limit) if limit else out


def search_text(df: DataFrame, column: str, text: str) -> DataFrame:
    """Distinct (hash, path, column) whose column holds text; % and _ in it are wildcards, case counts."""
    return df.where(F.col(column).isNotNull() & F.col(column).like(f"%{text}%")).select("hash", "path", column).distinct()


def json_strings(column: str, path: str) -> Column:
    return F.from_json(F.get_json_object(column, path), "array<string>")


def search_json_text(df: DataFrame, column: str, path: str, text: str) -> DataFrame:
    """Distinct rows with a string in the array at path that holds text."""
    return df.where(F.exists(json_strings(column, path), lambda x: x.like(f"%{text}%"))).select("hash", "path", column).distinct()


def search_content(df: DataFrame, column: str, path: str, conditions: dict | None = None) -> DataFrame:
    """Distinct rows whose array at path has members."""
    return equal_all(df, conditions or {}).where(F.coalesce(F.json_array_length(F.get_json_object(column, path)), F.lit(0)) > 0).select("hash", "path", column).distinct()


def search_variants(df: DataFrame, column: str, variants: Iterable[str], text: str | None = None) -> DataFrame:
    """One search for each variant's path, results appended; a row found under two variants stands twice."""
    found = []
    for v in variants:
        path = f"$.{v}.text.content"
        found.append(search_json_text(df, column, path, text) if text else search_content(df, column, path))
    return reduce(DataFrame.unionByName, found)


def search(df: DataFrame, text_search: dict | None = None, limit: int | None = None, partitions_too: bool = False, **keys) -> DataFrame:
    """text_search: column, text and maybe json_path. It is used alone unless partitions_too is set."""
    if not text_search:
        return search_partitions(df, limit, **keys)
    if partitions_too:
        df = partition_filter(df, **keys)
    column, text, path = text_search["column"], text_search["text"], text_search.get("json_path")
    out = search_json_text(df, column, path, text) if path else search_text(df, column, text)
    return out.limit(limit) if limit else out


def providers(df: DataFrame) -> DataFrame:
    return df.select("provider").distinct().orderBy("provider")


def without_reserved(df: DataFrame, meta: dict | None = None) -> DataFrame:
    """Without reserved columns and those that upload metadata shadow."""
    return df.drop(*RESERVED, *(meta or {}))


def rename_first(df: DataFrame, candidates: Iterable[str], to: str) -> DataFrame:
    """The first candidate that df has takes the canonical name."""
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumnRenamed(found, to) if found and found != to else df


def append_constants(df: DataFrame, values: dict) -> DataFrame:
    if missing := [k for k, v in values.items() if v is None]:
        raise ValueError(f"no value for {missing}")
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def nested_to_json(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON strings, decided by the schema."""
    return df.select(*[F.to_json(f"`{n}`").alias(n) if t.startswith(("struct", "array", "map")) else F.col(f"`{n}`") for n, t in df.dtypes])


def existing_paths(df: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is in the listing; null paths go."""
    return df.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_semi")


def without_backslash(df: DataFrame, column: str = "label") -> DataFrame:
    return df.where(F.instr(column, "\\") == 0)


def in_charset(column: Column, charset: str) -> Column:
    """Every character is in the set; an empty string is."""
    return F.translate(column, charset, "") == ""


def not_blank(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(column) != "")


def not_null_word(column: str) -> Column:
    """Not one of the words that stand for nothing."""
    return F.col(column).isNotNull() & ~F.lower(F.trim(column)).isin("none", "null", "")


def bounds(column: str, least=None, most=None, above=None, below=None) -> Column:
    """A number within bounds that are given; a null number is not."""
    c, out = F.col(column), F.col(column).isNotNull()
    for value, test in ((least, c.__ge__), (most, c.__le__), (above, c.__gt__), (below, c.__lt__)):
        if value is not None:
            out = out & test(value)
    return F.coalesce(out, F.lit(False))


def within(df: DataFrame, **ranges: tuple) -> DataFrame:
    """Rows whose columns are within (least, most); None is no bound."""
    return df.where(reduce(and_, [bounds(c, *r) for c, r in ranges.items()], F.lit(True)))


def containing(df: DataFrame, column: str, has: Iterable[str] = (), lacks: Iterable[str] = ()) -> DataFrame:
    """Rows whose text holds each of ``has`` and none of ``lacks``, as they stand."""
    tests = [F.contains(F.col(column), F.lit(x)) for x in has] + [~F.contains(F.col(column), F.lit(x)) for x in lacks]
    return df.where(reduce(and_, tests, F.col(column).isNotNull()))


def constant_if_absent(df: DataFrame, name: str, value) -> DataFrame:
    """A column that an upload has to have, with one value if df brings none."""
    return df if name in df.columns else df.withColumn(name, F.lit(value))
