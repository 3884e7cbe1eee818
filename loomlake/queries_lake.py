"""Queries through files: a stored catalogue, readers and sinks, exporters, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions.tables import spread
from loomlake.operators import aggregates as A
from loomlake.operators import search as SR
from loomlake.plans import exporters as E
from loomlake.plans.testviews import SQL, catalog, read
from loomlake.queries import query
from loomlake.sources import readers as R
from loomlake.sources import sinks as K
from loomlake.sources.footers import Catalog
from loomlake.sources.scratch import folder as scratch

C = f"with {SQL} "
KEYS = "provider, dataset, task, variant"


def stored(spark: SparkSession, sf: str) -> str:
    """The catalogue view written as a catalogue: a folder for each partition, columns without a value left out."""
    root = scratch(spark)
    d = catalog(spark, sf)
    for provider, columns in (("docs", ("label", "n_chars")), ("chat", ("label",)), ("web", ("label", "url")), ("log", ("meta", "value"))):
        part = d.where(F.col("provider") == provider).select("row_id", *columns, "hash", "path", *KEYS.split(", "))
        part = part.withColumn("row_id", F.col("row_id").cast("int")) if provider == "web" else part  # a type that differs
        K.write_catalog_partitions(part, root)
    return root


@query(C + f"select {KEYS}, count(*) num_samples from catalog group by all")
def catalog_scan(spark, sf) -> DataFrame:
    return A.partitions(R.scan_catalog(spark, stored(spark, sf)))


@query(C + "select row_id, label, n_chars, hash, path, provider, dataset, task, variant from catalog where provider = 'docs' and variant = 'de'")
def catalog_scan_search(spark, sf):
    return SR.search_partitions(R.scan_catalog(spark, stored(spark, sf)), provider="docs", variant=["de"])


@query(C + f"select {KEYS}, row_id, meta, value, hash, path from catalog where provider = 'log'")
def search_footers_events(spark, sf):
    """The search whose null columns are known from footers."""
    return Catalog(spark, stored(spark, sf), R.PARTITION_KEYS).search(provider="log")


@query(C + "select row_id, 'provider=' || provider || '/dataset=' || dataset folder from catalog where provider <> 'docs'")
def catalog_scan_filename(spark, sf):
    d = R.scan_catalog(spark, stored(spark, sf), filename=True).where("provider <> 'docs'")
    return d.select("row_id", F.regexp_extract("filename", "(provider=[^/]*/dataset=[^/]*)/", 1).alias("folder"))


@query(C + "select provider, count(*) n, count(distinct dataset) datasets from catalog group by 1")
def glob_scan(spark, sf):
    return R.scan_glob(spark, stored(spark, sf)).groupBy("provider").agg(F.count("*").alias("n"), F.countDistinct("dataset").alias("datasets"))


_SUPPLIERS = "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"


def _suppliers(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query(_SUPPLIERS)
def jsonl_round_trip(spark, sf):
    path = scratch(spark)
    K.write_jsonl(_suppliers(spark, sf), path)
    return R.read_jsonl(spark, path, _suppliers(spark, sf).schema)


@query(_SUPPLIERS)
def gzip_json(spark, sf):
    path = scratch(spark)
    _suppliers(spark, sf).write.option("compression", "gzip").json(path)
    return R.read_jsonl(spark, path, _suppliers(spark, sf).schema)


@query("select r_regionkey k, r_name name, n.n from region join (select n_regionkey, count(*) n from nation group by 1) n on n_regionkey = r_regionkey")
def json_documents(spark, sf):
    """One document a file, over several lines."""
    path = scratch(spark)
    n = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.collect_list("n_name").alias("nations"))
    d = read(spark, sf, "region").selectExpr("r_regionkey as k", "r_name as name").join(n, "k")
    text = F.to_json(F.struct("k", "name", "nations"), {"pretty": "true"})
    d.select(text.alias("value"), "k").repartitionByRange(5, "k").select("value").write.option("maxRecordsPerFile", 1).text(path)
    out = R.read_json_documents(spark, path, "k int, name string, nations array<string>")
    return out.select("k", "name", F.size("nations").cast("long").alias("n"))


@query(_SUPPLIERS)
def csv_round_trip(spark, sf):
    path = scratch(spark)
    _suppliers(spark, sf).write.option("header", True).csv(path)
    return R.read_csv(spark, path, _suppliers(spark, sf).schema)


@query("select s_suppkey::varchar \"key\", s_name || '=x,' || s_nationkey \"values\" from supplier")
def key_value_lines(spark, sf):
    path = scratch(spark)
    line = F.concat(F.lit("key="), "s_suppkey", F.lit(" v="), "s_name", F.lit("=x  plain\tv="), "s_nationkey")
    K.write_lines(read(spark, sf, "supplier").select(line.alias("line")).union(spark.sql("select '  '")), "line", path)
    return R.read_key_values(spark, path).select(F.col("fields")["key"][0].alias("key"), F.array_join(F.col("fields")["v"], ",").alias("values"))


@query("select case when s_suppkey % 3 = 0 then 'test' else 'train' end split, count(*) n, sum(s_nationkey)::bigint total from supplier group by 1")
def splits_by_glob(spark, sf):
    root = scratch(spark)
    d = _suppliers(spark, sf)
    d.where("s_suppkey % 3 = 0").write.parquet(f"{root}/test-0")
    d.where("s_suppkey % 3 <> 0").write.parquet(f"{root}/train-0")
    out = R.read_splits(spark, {"train": f"{root}/train-*", "test": f"{root}/test-*", "val": f"{root}/val-*"})
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("s_nationkey").cast("long").alias("total"))


@query(_SUPPLIERS)
def parquet_sources(spark, sf):
    """A path, a pandas frame and a DataFrame, by one dispatch."""
    d = _suppliers(spark, sf)
    path = scratch(spark)
    d.where("s_suppkey % 3 = 0").write.parquet(path)
    small = d.where("s_suppkey % 3 = 1").toPandas()
    return R.load_source(spark, path).unionByName(R.load_source(spark, small).select(*[F.col(f.name).cast(f.dataType) for f in d.schema])).unionByName(R.load_source(spark, d.where("s_suppkey % 3 = 2")))


# --- exporters


@query("""with q as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) k from conversations)
select conv_id || '.jpg' image, 2 * count(*) turns, '<image>' || min_by(text, turn) "first" from q group by conv_id""")
def export_vqa(spark, sf):
    d = read(spark, sf, "conversations").selectExpr("concat(conv_id, '.jpg') as path", "text as query", "role as label", "turn")
    return E.vqa(d, "turn").select(F.col("images")[0].alias("image"), F.size("messages").cast("long").alias("turns"), F.col("messages")[0]["content"].alias("first"))


@query("""select p_partkey || '.jpg' image, '<image>Parse the table in the image.' query, '<otsl><fcel>' || p_name || '</otsl>' answer from part where p_size % 4 <> 0 and p_size % 4 <> 1""")
def export_otsl(spark, sf):
    label = F.expr(r"case p_size % 4 when 0 then null when 1 then concat(p_name, '\\frac') else concat('x <otsl><fcel>', p_name, '</otsl> y') end")
    out = E.otsl(read(spark, sf, "part").select(F.concat("p_partkey", F.lit(".jpg")).alias("path"), label.alias("label")), max_tags=9)
    return out.select(F.col("images")[0].alias("image"), F.col("messages")[0]["content"].alias("query"), F.col("messages")[1]["content"].alias("answer"))


@query("select c_custkey || '.jpg' image, '<image>Read text in the image.' query, c_mktsegment answer from customer where regexp_matches(c_mktsegment, '^[ABDGILNUEHOST]*$')")
def export_recognition(spark, sf):
    out = E.recognition(read(spark, sf, "customer").select(F.concat("c_custkey", F.lit(".jpg")).alias("path"), F.col("c_mktsegment").alias("label")), "ABDGILNUEHOST")
    return out.select(F.col("images")[0].alias("image"), F.col("messages")[0]["content"].alias("query"), F.col("messages")[1]["content"].alias("answer"))


_SIZED = "p as (select *, case when p_size = 1 then 56 else p_size * 28 end w, case when p_size = 1 then 84 else 56 end h from part)"  # 28 x 56 is too small and grows


@query(f"""with {_SIZED} select p_partkey || '.jpg' image, '[{{"type":"table","bbox":[0,0,' || w || ',' || h // 2 || ']}}]' answer,
  case when p_size % 2 = 0 then '<image>Extract all layout elements. Reading order must be preserved.' else '<image>Extract all layout elements. Reading order does not matter.' end query from p""")
def export_layout(spark, sf):
    label = F.expr("""concat('{"page":1,"reading_order":', if(p_size % 2 = 0, 'true', 'false'), ',"elements":[{"idx":1,"type":"table","value":"v","bbox":[0,0,1,0.5]}]}')""")
    d = read(spark, sf, "part").select(F.concat("p_partkey", F.lit(".jpg")).alias("path"), (F.col("p_size") * 28).alias("width"), F.lit(56).alias("height"), label.alias("label"))
    out = E.layout(d)
    return out.select(F.col("images")[0].alias("image"), F.col("messages")[0]["content"].alias("query"), F.col("messages")[1]["content"].alias("answer"))


@query(f"""with {_SIZED} select p_partkey || '.jpg' image, '{{"nm":{{"<|value|>":"' || p_name || '","<|bbox|>":[0,' || h // 2 || ',' || w // 2 || ',' || h || ']}}}}' answer, true asks from p""")
def export_kie(spark, sf):
    label = F.concat(F.lit('{"nm":{"<|value|>":"'), "p_name", F.lit('","<|bbox|>":[0,0.5,0.5,1]},"none":null}'))
    d = spread(read(spark, sf, "part")).select(F.concat("p_partkey", F.lit(".jpg")).alias("path"), (F.col("p_size") * 28).alias("width"), F.lit(56).alias("height"), label.alias("label"))
    out = E.kie(d)
    return out.select(F.col("images")[0].alias("image"), F.col("messages")[1]["content"].alias("answer"), F.endswith(F.col("messages")[0]["content"], F.lit('\n{"nm":{"<|value|>":"","<|bbox|>":[]}}')).alias("asks"))


@query("""select p_partkey || '_' || i || '.jpg' image, case i when 0 then '<image>Parse the table in the image.' else '<image>Read text in the image.' end query, p_name || i answer from part, unnest([0, 2]) t(i)""")
def export_element_crops(spark, sf):
    label = F.concat(F.lit('{"elements":[{"idx":1,"type":"table","value":"'), "p_name", F.lit('0","bbox":[0,0,1,1]},{"idx":2,"type":"title","value":"","bbox":[0,0,1,1]},{"idx":3,"type":"chart","value":"'), "p_name", F.lit('2","bbox":[0,0,1,1]}]}'))
    out = E.element_crops(read(spark, sf, "part").select(F.concat("p_partkey", F.lit(".png")).alias("path"), label.alias("label")))
    return out.select(F.col("images")[0].alias("image"), F.col("messages")[0]["content"].alias("query"), F.col("messages")[1]["content"].alias("answer"))


@query("""with g as (select c_nationkey g, c_custkey k, c_name v, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 2 n from customer)
select g, n grp, string_agg(v, chr(10) order by k) label, 120 width, 2 * 20 + 3 * 10 height from g group by g, n having count(*) = 2""")
def export_paragraphs(spark, sf):
    d = read(spark, sf, "customer").selectExpr("c_nationkey as g", "c_custkey as k", "concat(c_custkey, '.jpg') as path", "c_name as label", "100 as width", "20 as height")
    return E.paragraphs(d, "g", "k", 2).select("g", "grp", "label", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
