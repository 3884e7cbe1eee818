"""The driver tables in the shape of a catalogue, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.sources.readers import union_by_name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(df: DataFrame, provider: str, dataset, task: str, variant, row_id, **extra) -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(F.lit(provider).alias("provider"), lit(dataset).alias("dataset"), F.lit(task).alias("task"), lit(variant).alias("variant"), row_id.cast("long").alias("row_id"), *[c.alias(k) for k, c in extra.items()])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over four tables; filters on provider prune whole tables."""
    c = F.col
    df = union_by_name([
        _part(read(spark, sf_dir, "documents"), "docs", c("source"), "raw", c("lang"), c("doc_id"), label=c("text"), n_chars=c("n_chars")),
        _part(read(spark, sf_dir, "conversations"), "chat", "conv", "vqa", c("role"), c("conv_id") * 1000 + c("turn"), label=c("text")),
        _part(read(spark, sf_dir, "pages"), "web", "pages", "document_conversion", "table_html", c("page_id"), label=c("html"), url=c("url")),
        _part(read(spark, sf_dir, "events"), "log", c("event_type"), "ocr", "base_ocr", c("event_id"), meta=c("props"), value=c("value")),
    ])
    df = df.withColumn("hash", F.sha2(F.coalesce("label", "meta"), 256))
    return df.withColumn("path", F.concat(F.lit("provider="), "provider", F.lit("/dataset="), "dataset", F.lit("/"), F.substring("hash", 1, 2), F.lit("/"), "hash", F.lit(".jpg")))


SQL = """catalog0 as (
  select 'docs' provider, source dataset, 'raw' task, lang variant, doc_id row_id, text label, n_chars, null url, null meta, null::double value from documents
  union all select 'chat', 'conv', 'vqa', role, conv_id * 1000 + turn, text, null, null, null, null from conversations
  union all select 'web', 'pages', 'document_conversion', 'table_html', page_id, html, null, url, null, null from pages
  union all select 'log', event_type, 'ocr', 'base_ocr', event_id, null, null, null, props, value from events),
catalog1 as (select *, sha256(coalesce(label, meta)) hash from catalog0),
catalog as (select *, 'provider=' || provider || '/dataset=' || dataset || '/' || hash[1:2] || '/' || hash || '.jpg' path from catalog1)"""


def _spots(base: DataFrame) -> DataFrame:
    content = lambda c: F.struct(F.struct(c.alias("content")).alias("text"))
    spot = F.to_json(F.struct(content(F.split("label", " ")).alias("word"), content(F.split("label", "\n")).alias("line")))
    return base.select("row_id", "hash", "path", "dataset", spot.alias("spot"))


def spotter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as spotter JSON: the words of a text as an array at $.word.text.content, of its lines at $.line."""
    return _spots(catalog(spark, sf_dir).where("provider = 'docs'"))


SPOTTER_SQL = SQL + """,
spotter as (select row_id, hash, path, dataset,
  to_json({'word': {'text': {'content': string_split(label, ' ')}}, 'line': {'text': {'content': string_split(label, chr(10))}}})::varchar spot
  from catalog where provider = 'docs')"""


def lines(spark: SparkSession, sf_dir: str, per_task: int = 500_000) -> DataFrame:
    """Line items with one row for each order and line number. They are dealt by order, which is what most queries go by
    next, to a task for each ``per_task`` of them where these are more than the session's number of tasks."""
    own = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    items = read(spark, sf_dir, "lineitem")
    tasks = -(-items.count() // per_task)
    dealt = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    return items.repartition(*dealt, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in own])


LINES_SQL = """lines as (select l_orderkey, l_linenumber, min(l_partkey) l_partkey, min(l_suppkey) l_suppkey, min(l_quantity) l_quantity,
  min(l_returnflag) l_returnflag from lineitem group by 1, 2)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes on pages: an order is a page."""
    return lines(spark, sf_dir).selectExpr(
        "l_orderkey as page", "l_linenumber as box_id", "l_partkey % 1000 as x1", "l_suppkey % 100 * 7 as y1",
        "l_partkey % 1000 + cast(l_quantity as int) * 4 as x2", "l_suppkey % 100 * 7 + cast(l_quantity as int) as y2", "l_partkey", "l_suppkey", "l_returnflag",
    )


BOXES_SQL = LINES_SQL + """, boxes as (select l_orderkey page, l_linenumber box_id, l_partkey % 1000 x1, l_suppkey % 100 * 7 y1,
  l_partkey % 1000 + l_quantity::int * 4 x2, l_suppkey % 100 * 7 + l_quantity::int y2, l_partkey, l_suppkey, l_returnflag from lines)"""
