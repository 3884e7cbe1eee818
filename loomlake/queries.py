"""The engine's own queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import geometry as G
from loomlake.functions import jsontree as J
from loomlake.functions import tables as H
from loomlake.functions import text as X
from loomlake.operators import aggregates as A
from loomlake.operators import joins as JN
from loomlake.operators import sampling as S
from loomlake.operators import search as SR
from loomlake.operators import windows as W
from loomlake.plans import schema as SC
from loomlake.plans.testviews import BOXES_SQL, LINES_SQL, SPOTTER_SQL, SQL, boxes, catalog, lines, read, spotter
from loomlake.streaming.drain import windowed_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


C = f"with {SQL} "
KEYS = "provider, dataset, task, variant"


# --- catalogue and search


@query(C + f"select {KEYS}, count(*) num_samples from catalog group by all")
def partitions(spark, sf) -> DataFrame:
    return A.partitions(catalog(spark, sf))


@query(C + "select distinct provider from catalog")
def providers(spark, sf):
    return SR.providers(catalog(spark, sf))


@query(C + "select count(*) total from catalog")
def total_rows(spark, sf):
    return catalog(spark, sf).agg(F.count("*").alias("total"))


@query(C + f", p as (select distinct {KEYS} from catalog) " + " union all ".join(f"select '{k}' \"level\", {k} \"value\", count(*) num_partitions from p group by {k}" for k in KEYS.split(", ")))
def partition_stats_by_level(spark, sf):
    return A.level_stats(catalog(spark, sf))


@query(C + f", p as (select distinct {KEYS} from catalog) select provider, " + ", ".join(f"coalesce(nullif(count(*) filter (task = '{t}'), 0)::varchar, '-') {t}" for t in ("document_conversion", "ocr", "raw", "vqa")) + " from p group by provider")
def partition_matrix(spark, sf):
    return A.level_matrix(catalog(spark, sf), "provider", "task", ["document_conversion", "ocr", "raw", "vqa"])


@query(C + "select provider, dataset, count(*) n from catalog group by all")
def rows_per_dataset(spark, sf):
    return catalog(spark, sf).groupBy("provider", "dataset").agg(F.count("*").alias("n"))


@query(C + f"select {KEYS}, row_id, label, n_chars, hash, path from catalog where provider = 'docs' and variant in ('de', 'fr')")
def search_partition(spark, sf):
    return SR.search_partitions(catalog(spark, sf), provider="docs", variant=["de", "fr"])


@query(C + f"select {KEYS}, row_id, label, url, hash, path from catalog where provider in ('chat', 'web') and task in ('vqa', 'document_conversion')")
def search_partition_multi(spark, sf):
    return SR.search(catalog(spark, sf), provider=["chat", "web", ""], task=["vqa", "document_conversion"], dataset=None)


@query(C + f"select {KEYS}, row_id, meta, value, hash, path from catalog where provider = 'log'")
def search_nonnull_cols_events(spark, sf):
    return SR.search_partitions(catalog(spark, sf), provider="log")


@query(C + "select distinct hash, path, label from catalog where label like '%the%'")
def search_text_simple(spark, sf):
    return SR.search_text(catalog(spark, sf), "label", "the")


@query(C + '''select distinct hash, path, label from catalog where label like '%lang="_r"%nav%' ''')
def search_text_wildcard(spark, sf):
    return SR.search(catalog(spark, sf), {"column": "label", "text": 'lang="_r"%nav'}, provider="web")


def _json_hits(variant: str, text: str | None) -> str:
    path = f"$.{variant}.text.content"
    hit = f"exists (select 1 from (select unnest(cast(json_extract(spot, '{path}') as varchar[])) u) where u like '%{text}%')" if text else f"json_array_length(spot, '{path}') > 0"
    return f"select distinct hash, path, spot from spotter where {hit}"


@query(f"with {SPOTTER_SQL} " + _json_hits("word", "the"))
def search_json_array_text(spark, sf):
    return SR.search_json_text(spotter(spark, sf), "spot", "$.word.text.content", "the")


@query(f"with {SPOTTER_SQL} " + _json_hits("line", None) + " and dataset = 'src3'")
def search_valid_content(spark, sf):
    return SR.search_content(spotter(spark, sf), "spot", "$.line.text.content", {"dataset": "src3"})


@query(f"with {SPOTTER_SQL} " + " union all ".join(f"({_json_hits(v, 'ing')})" for v in ("word", "line")))
def search_variants_union(spark, sf):
    return SR.search_variants(spotter(spark, sf), "spot", ["word", "line"], "ing")


@query(C + "select row_id, cast(json_extract(meta, '$.k') as bigint) k from catalog where provider = 'log'")
def json_value(spark, sf):
    return catalog(spark, sf).where("provider = 'log'").select("row_id", F.get_json_object("meta", "$.k").cast("long").alias("k"))


@query(C + "select row_id, path, '/lake/assets/' || path absolute from catalog where provider = 'web'")
def abs_path(spark, sf):
    return catalog(spark, sf).where("provider = 'web'").select("row_id", "path", X.absolute_path(F.col("path"), "/lake/assets").alias("absolute"))


@query(C + "select row_id, hash, path from catalog where dataset = 'click' or dataset = 'view' and value > 50")
def precedence_or_and(spark, sf):
    return catalog(spark, sf).where("dataset = 'click' or dataset = 'view' and value > 50").select("row_id", "hash", "path")


@query(C + "select row_id from catalog where label is not null and instr(label, '\\') = 0 and trim(label) <> ''")
def latex_filter(spark, sf):
    return SR.without_backslash(catalog(spark, sf).where(SR.not_blank("label"))).select("row_id")


@query("select c_custkey, c_mktsegment from customer where regexp_matches(c_mktsegment, '^[ABDGILNUEHOST]*$')")
def charset_filter(spark, sf):
    return read(spark, sf, "customer").where(SR.in_charset(F.col("c_mktsegment"), "ABDGILNUEHOST")).select("c_custkey", "c_mktsegment")


_WORDS = "case c_custkey % 5 when 0 then ' None' when 1 then 'NULL ' when 2 then ' ' when 3 then null else c_mktsegment end"


@query(f"select c_custkey, word from (select c_custkey, {_WORDS} word from customer) where lower(trim(word)) not in ('none', 'null', '')")
def null_word_filter(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.expr(_WORDS).alias("word")).where(SR.not_null_word("word"))


@query("select s_suppkey, {'a': s_name, 'n': s_nationkey}::json::varchar j from supplier")
def nested_to_json(spark, sf):
    df = read(spark, sf, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("a"), F.col("s_nationkey").alias("n")).alias("j"))
    return SR.nested_to_json(df)


# --- order-dependent operators


@query(C + "select provider, row_id, hash from (select *, row_number() over (partition by hash order by provider, row_id) n from catalog) where n = 1")
def dedup_first_by_hash(spark, sf):
    df = catalog(spark, sf).select("provider", "row_id", "hash", F.struct("provider", "row_id").alias("o"))
    return W.first_of(df, ["hash"], "o").drop("o")


@query(C + "select provider, row_id, hash from (select *, count(*) over (partition by hash) n from catalog where provider = 'docs') where n > 1")
def duplicated_all(spark, sf):
    return W.all_duplicates(catalog(spark, sf).where("provider = 'docs'").select("provider", "row_id", "hash"), ["hash"])


@query(C + "select distinct hash, path from catalog where hash is not null and path is not null")
def distinct_hash_path(spark, sf):
    return W.distinct_assets(catalog(spark, sf))


@query(f"with {LINES_SQL} select l_orderkey, l_linenumber, case when max((l_suppkey % 3 <> 0)::int) over (partition by l_orderkey) = 1 then l_suppkey % 3 else row_number() over (partition by l_orderkey order by l_linenumber) end idx from lines")
def element_index(spark, sf):
    df = lines(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("p"))
    return W.element_index(df, "l_orderkey", "l_linenumber", "p").drop("p")


_NEAR = "select page, box_id, exists (select 1 from boxes b where b.page = a.page and b.box_id <> a.box_id and least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0 and least(a.y2, b.y2) - greatest(a.y1, b.y1) >= 0.2::double * least(a.y2 - a.y1, b.y2 - b.y1)) has_neighbour"


@query(f"with {BOXES_SQL} {_NEAR} from boxes a")
def y_overlap_semi(spark, sf):
    return JN.with_neighbour(boxes(spark, sf)).select("page", "box_id", "has_neighbour")


@query(f"""with {BOXES_SQL}, h as ({_NEAR}, x1, y1, x2, y2 from boxes a),
m as (select *, (x1 + x2) / 2 x, (y1 + y2) / 2 y, min(case when has_neighbour then (x1 + x2) / 2 end) over (partition by page) lo,
  max(case when has_neighbour then (x1 + x2) / 2 end) over (partition by page) hi from h),
c as (select *, case when not has_neighbour then -1 when hi = lo then 2 else least(floor((x - lo) / (hi - lo) * 3), 2) end::int col from m)
select page, box_id, col, row_number() over (partition by page order by col, y, box_id) reading_order from c""")
def reading_order(spark, sf):
    return W.reading_order(JN.with_neighbour(boxes(spark, sf))).select("page", "box_id", "col", "reading_order")


@query(f"""with {BOXES_SQL}, r as (select *, max(y2) over (partition by page order by y1, box_id rows between unbounded preceding and 1 preceding) reach from boxes),
l as (select *, sum(case when reach is null or (y1 + y2) / 2 >= reach then 1 else 0 end) over (partition by page order by y1, box_id) line from r)
select page, box_id, line::bigint line, row_number() over (partition by page, line order by x1, box_id) place from l""")
def line_order(spark, sf):
    return W.line_order(boxes(spark, sf).withColumnRenamed("box_id", "word_id")).select("page", F.col("word_id").alias("box_id"), "line", "place")


@query("select * exclude (n), format('batch_{:04d}', n // 1000) batch, format('file_{:06d}', n) file from (select *, row_number() over (partition by event_type order by event_id) - 1 n from events)")
def batch_folder(spark, sf):
    return W.batch_names(read(spark, sf, "events"), "event_type", "event_id")


@query("select s_nationkey, s_suppkey, grp from (select *, count(*) over (partition by s_nationkey, grp) c from (select *, (row_number() over (partition by s_nationkey order by s_suppkey) - 1) // 3 grp from supplier)) where c = 3")
def compose_groups(spark, sf):
    return W.fixed_groups(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey", 3).select("s_nationkey", "s_suppkey", "grp")


@query("select 'v' || (max(s_suppkey % 17) + 1) next_version from supplier where s_suppkey % 5 <> 0")
def next_version(spark, sf):
    v = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("v"), F.col("s_suppkey") % 17)).otherwise(F.concat(F.lit("x"), "s_suppkey"))
    return W.next_version(read(spark, sf, "supplier").select(v.alias("version")))


@query("select s_name, row_number() over (order by regexp_extract(s_name, '^([^0-9]*)', 1), cast(regexp_extract(s_name, '([0-9]+)', 1) as bigint), s_name) place from supplier")
def natural_sort(spark, sf):
    df = read(spark, sf, "supplier").select("s_name", F.lit(0).alias("all"))
    return W.numbered(df, "all", S.natural_key("s_name"), "place").select("s_name", (F.col("place") + 1).alias("place"))


# --- aggregations


@query(C + ", r as (select path, hash, path in (select path from catalog where provider <> 'web') found from catalog where path is not null and hash is not null) select count(*) checked, count(*) filter (not found) missing, round((count(*) - count(*) filter (not found)) / count(*) * 100, 2) integrity_rate from r")
def integrity_report(spark, sf):
    df = catalog(spark, sf)
    return A.integrity(df, df.where("provider <> 'web'"))


@query("select event_type, format('{:.1f}%', count(*) filter (value > 50) / count(*) * 100) success_rate from events group by event_type")
def success_rate(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(A.success_rate(F.count(F.when(F.col("value") > 50, 1)), F.count("*")).alias("success_rate"))


@query("select event_type, count(*) n, min(event_id) first_seen from events group by 1 order by 2 desc, 3 limit 3")
def top3_event_types(spark, sf):
    return A.top_values(read(spark, sf, "events"), "event_type", "event_id")


@query("with c as (select user_id, event_type, count(*) n, min(event_id) f from events group by all) select user_id, arg_max(event_type, {'n': n, 'f': -f}) as \"mode\", max(n) n from c group by user_id")
def mode_per_group(spark, sf):
    return A.mode_by(read(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("select conv_id, array_to_string(list(role order by turn), '|') roles, sum(length(text))::bigint chars from conversations group by conv_id")
def multiturn_group(spark, sf):
    g = A.grouped_lists(read(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])
    return g.select("conv_id", F.array_join("role", "|").alias("roles"), F.aggregate("text", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("chars"))


@query("select unnest([0.9, 0.95, 0.98, 0.99, 0.999, 1.0])::double q, round(unnest(quantile_cont(n_chars, [0.9, 0.95, 0.98, 0.99, 0.999, 1.0])), 6) \"value\" from documents")
def token_quantiles(spark, sf):
    return A.quantiles(read(spark, sf, "documents"), "n_chars").select("q", F.round("value", 6).alias("value"))


@query(f"with {BOXES_SQL} select page, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from boxes group by page")
def bbox_union(spark, sf):
    return A.bbox_union(boxes(spark, sf), "page")


@query("select source, case when count(distinct lang) > 1 then 'multi' else max(lang) end lang from documents group by source")
def lang_multi_collapse(spark, sf):
    return A.collapse_multi(read(spark, sf, "documents"), "source", "lang")


@query("select count(*) total, count(distinct text) \"distinct\", count(*) = count(distinct text) is_unique from documents")
def unique_counts(spark, sf):
    return A.unique_counts(read(spark, sf, "documents"), "text")


@query("select date_trunc('hour', ts) as \"start\", event_type, count(*) n, round(sum(value), 6) total from events group by all")
def windowed_events(spark, sf):
    return windowed_counts(read(spark, sf, "events")).withColumns({"total": F.round("total", 6), "start": F.col("start").cast("timestamp_ntz")})


# --- joins


@query("select n_nationkey, n_name, coalesce(c.n, 0) n_customers, c.first from nation left join (select c_nationkey, count(*) n, min(c_custkey) first from customer group by 1) c on n_nationkey = c_nationkey")
def image_annotations_join(spark, sf):
    ann = read(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("annotation_id"), "c_name")
    out = JN.with_annotations(read(spark, sf, "nation"), ann, "n_nationkey")
    return out.select("n_nationkey", "n_name", F.size("annotations").cast("long").alias("n_customers"), F.try_element_at("annotations", F.lit(1))["annotation_id"].alias("first"))


@query("select s_suppkey, coalesce(n_name, 'other') n_name from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 10")
def category_lookup(spark, sf):
    dim = read(spark, sf, "nation").where("n_nationkey < 10").withColumnRenamed("n_nationkey", "s_nationkey")
    return JN.lookup(read(spark, sf, "supplier"), dim, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("select c_custkey, l.p from customer join (select o_custkey, arg_max(o_orderpriority, o_orderkey) p from orders group by 1) l on o_custkey = c_custkey")
def label_lookup_last(spark, sf):
    labels = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return JN.match_labels(read(spark, sf, "customer").select("c_custkey"), labels, "c_custkey", "p", "o_orderkey")[0]


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 200000)")
def label_lookup_anti(spark, sf):
    orders = read(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return JN.difference(read(spark, sf, "customer").select("c_custkey"), orders, "c_custkey")


@query("with a as (select *, row_number() over (partition by s_nationkey order by s_suppkey) p from supplier), b as (select *, row_number() over (partition by c_nationkey order by c_custkey) p from customer) select s_nationkey nation, s_suppkey, c_custkey from a join b on s_nationkey = c_nationkey and a.p = b.p")
def positional_join(spark, sf):
    a = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    b = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return JN.zip_rows(a, b, ["nation"], "s_suppkey", "c_custkey")


_SPANS = "spans as (select page doc_id, box_id span_id, x1 as s, x1 + 40 e from boxes where l_returnflag = 'A'), tokens as (select page doc_id, x1 ts, x2 te, case when l_suppkey % 9 = 0 then -1 else x1 end x1, y1, x2, y2 from boxes)"


@query(f"with {BOXES_SQL}, {_SPANS}, h as (select s.doc_id, span_id, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 from spans s join tokens t on s.doc_id = t.doc_id and greatest(s, ts) < least(e, te) and least(x1, y1, x2, y2) <> -1 and x1 <= x2 and y1 <= y2 group by all) select s.doc_id, s.span_id, coalesce(x1, 0) x1, coalesce(y1, 0) y1, coalesce(x2, 0) x2, coalesce(y2, 0) y2 from spans s left join h on s.doc_id = h.doc_id and s.span_id = h.span_id")
def interval_overlap_join(spark, sf):
    b = boxes(spark, sf)
    spans = b.where("l_returnflag = 'A'").selectExpr("page as doc_id", "box_id as span_id", "x1 as start", "x1 + 40 as end")
    tokens = b.selectExpr("page as doc_id", "x1 as t_start", "x2 as t_end", "if(l_suppkey % 9 = 0, -1, x1) as x1", "y1", "x2", "y2")
    return JN.span_boxes(spans, tokens).select("doc_id", "span_id", "x1", "y1", "x2", "y2")


@query(f"with {BOXES_SQL}, w as (select page, box_id word_id, x1, y1, x1 + 8 x2, y1 + 4 y2 from boxes), s as (select page, box_id shape_id, x1 a1, y1 b1, x2 a2, y2 b2 from boxes) select w.page, word_id, min(case when greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) > 0.85 * 32 then shape_id end) shape_id from w join s on w.page = s.page group by all")
def containment_first_match(spark, sf):
    b = boxes(spark, sf)
    words = b.selectExpr("page", "box_id as word_id", "x1", "y1", "x1 + 8 as x2", "y1 + 4 as y2")
    shapes = b.selectExpr("page", "box_id as shape_id", "x1 as s_x1", "y1 as s_y1", "x2 as s_x2", "y2 as s_y2")
    return JN.first_container(words, shapes).select("page", "word_id", "shape_id")


@query(f"with {LINES_SQL}, b as (select l_orderkey doc_id, l_suppkey % 2 page, l_linenumber idx, l_partkey % 7 parent from lines), n as (select *, row_number() over (partition by doc_id, page order by idx) - 1 new_idx from b) select n.doc_id, n.page, n.new_idx, coalesce(m.new_idx, -1) new_parent from n left join n m on n.doc_id = m.doc_id and n.page = m.page and n.parent = m.idx")
def parent_remap(spark, sf):
    b = lines(spark, sf).selectExpr("l_orderkey as doc_id", "l_suppkey % 2 as page", "cast(l_linenumber as long) as idx", "l_partkey % 7 as parent")
    return JN.remap_parents(b).select("doc_id", "page", "new_idx", "new_parent")


@query(f"with {LINES_SQL}, a as (select l_orderkey doc_id, l_linenumber ann_id, case when l_partkey % 5 = 0 then ' ' else 't' || l_partkey % 50 end as text, case when l_linenumber > 1 then l_linenumber - 1 end link from lines) select doc_id, \"key\", arg_max(v, ann_id) \"value\" from (select a.doc_id, k.text as \"key\", a.text v, a.ann_id from a join a k on a.doc_id = k.doc_id and a.link = k.ann_id where trim(a.text) <> '') group by all")
def link_key_values(spark, sf):
    a = lines(spark, sf).selectExpr("l_orderkey as doc_id", "l_linenumber as ann_id", "if(l_partkey % 5 = 0, ' ', concat('t', l_partkey % 50)) as text", "if(l_linenumber > 1, l_linenumber - 1, null) as link")
    return JN.key_values(a)


@query(f"with {LINES_SQL}, m as (select l_orderkey doc_id, l_suppkey % 3 link_id, l_linenumber node, 2 + l_partkey % 2 lab, 't' || l_partkey % 40 as text from lines) select k.doc_id, k.node key_node, k.text as \"key\", array_to_string(list(distinct v.text order by v.text), ',') as \"values\" from m k join m v on k.doc_id = v.doc_id and k.link_id = v.link_id and k.lab = 2 and v.lab = 3 group by k.doc_id, k.node, k.text")
def link_group_pairs(spark, sf):
    b = lines(spark, sf)
    links = b.selectExpr("l_orderkey as doc_id", "l_suppkey % 3 as link_id", "l_linenumber as node")
    nodes = b.selectExpr("l_orderkey as doc_id", "l_linenumber as node", "2 + l_partkey % 2 as label", "concat('t', l_partkey % 40) as text")
    return JN.link_pairs(links, nodes).withColumn("values", F.array_join("values", ","))


@query(f"with {LINES_SQL} select l_orderkey doc_id, l_suppkey % 2 line_id, string_agg(n_name, ' ' order by l_linenumber) as text from lines join nation on l_partkey % 30 = n_nationkey group by all")
def id_list_expand(spark, sf):
    b = lines(spark, sf).selectExpr("l_orderkey as doc_id", "l_suppkey % 2 as line_id", "l_linenumber", "cast(l_partkey % 30 as int) as w")
    wanted = b.groupBy("doc_id", "line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "w"))), lambda x: x["w"]).alias("word_ids"))
    words = b.select("doc_id").distinct().join(F.broadcast(read(spark, sf, "nation").selectExpr("n_nationkey as word_id", "n_name as text")))
    return JN.expand_ids(wanted, words)


@query("select p_partkey, levenshtein(p_name, p_type) / length(p_type) cer from part where length(p_type) > 0")
def levenshtein_cer(spark, sf):
    return read(spark, sf, "part").where("length(p_type) > 0").select("p_partkey", JN.cer(F.col("p_name"), F.col("p_type")).alias("cer"))


@query("""with recursive r as (select p_size g, p_partkey pos, p_name[2:] ref, row_number() over (partition by p_size order by p_partkey) k from part),
s as (select r.g, r.k, r.pos, r.ref, t.p_partkey idx, t.p_name txt, row_number() over (partition by r.g, r.pos order by levenshtein(r.ref, t.p_name) / length(t.p_name), t.p_partkey) place from r join part t on r.g = t.p_size),
l as (select g, k, any_value(pos) pos, any_value(ref) ref, list(idx order by place) ids, list(txt order by place) texts from s group by g, k),
a as (select g, 0::bigint k, null::bigint pos, ''::varchar ref, ''::varchar txt, []::bigint[] used from (select distinct g from r)
  union all select l.g, l.k, l.pos, l.ref, l.texts[list_position(l.ids, c.i)], list_append(a.used, c.i)
  from a join l on l.g = a.g and l.k = a.k + 1, lateral (select list_filter(l.ids, lambda x: not list_contains(a.used, x))[1] i) c)
select g, pos, ref, txt as text from a where k > 0""")
def greedy_cer_assignment(spark, sf):
    p = read(spark, sf, "part").selectExpr("p_size as g", "p_partkey", "p_name")
    refs = p.selectExpr("g", "p_partkey as pos", "substring(p_name, 2) as ref")
    texts = p.selectExpr("g", "p_partkey as idx", "p_name as text")
    return JN.assign_by_cer(refs, texts, "g")


@query("select distinct on (sha256(text)) sha256(text) hash from documents where sha256(text) not in (select sha256(text) from documents where source = 'src0')")
def new_assets_anti(spark, sf):
    d = read(spark, sf, "documents").select(F.lit("docs").alias("provider"), F.lit("d").alias("dataset"), "source", F.sha2("text", 256).alias("hash"))
    return JN.new_assets(d, d.where("source = 'src0'")).select("hash")


# --- samples and splits


@query("select doc_id from documents order by sha256(doc_id || '-42'), doc_id limit (select cast(floor(count(*) * 0.1) as bigint) from documents)")
def sample_exact(spark, sf):
    return S.sample_fraction(read(spark, sf, "documents"), 0.1, "doc_id").select("doc_id")


@query("select doc_id, case when row_number() over (order by sha256(doc_id || '-42')) <= (select ceil(count(*) * 0.1) from documents) then 'test' else 'train' end split from documents")
def split_train_test(spark, sf):
    return S.split(read(spark, sf, "documents"), 0.1, "doc_id").select("doc_id", "split")


# --- text and paths


@query(C + ", n as (select count(*) n from catalog where provider = 'log') select row_id, case when n < 10000 then hash || '.jpg' when n < 2500000 then hash[1:2] || '/' || hash || '.jpg' else hash[1:2] || '/' || hash[3:4] || '/' || hash || '.jpg' end shard from catalog, n where provider = 'log'")
def asset_shard_path(spark, sf):
    df = catalog(spark, sf).where("provider = 'log'")
    n = df.count()
    return df.select("row_id", F.regexp_replace(X.shard_path(F.lit(""), F.col("hash"), X.shard_levels(F.lit(n))), "^/", "").alias("shard"))


@query(r"""with n as (select page_id, split_part(string_split(url, '/')[-1], '?', 1) f from pages), r as (select page_id, regexp_replace(f, '[<>:"/\\|?*]', '_', 'g') f from n) select page_id, case when lower(f) like '%.pdf' then f else f || '.pdf' end file from r""")
def url_to_filename(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.url_to_filename(F.col("url")).alias("file"))


@query(C + r"select row_id, regexp_extract(path, 'dataset=([^/]+)', 1) dataset, regexp_extract(path, '([^/]+)\.[^./]*$', 1) stem from catalog where provider = 'web'")
def path_parts(spark, sf):
    df = catalog(spark, sf).where("provider = 'web'")
    return df.select("row_id", X.hive_value(F.col("path"), "dataset").alias("dataset"), X.stem(F.col("path")).alias("stem"))


@query(r"select page_id, len(regexp_extract_all(html, '</?[\p{L}_]+>')) tags from pages")
def tag_count(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.tag_count(F.col("html")).cast("long").alias("tags"))


@query("select doc_id, case when doc_id % 3 = 0 then null else '<otsl><fcel>' || text || '</otsl>' end otsl from documents")
def extract_otsl(spark, sf):
    wrapped = F.concat(F.lit("x <otsl><fcel>"), "text", F.lit("</otsl> tail <otsl>2</otsl>"))
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(wrapped)
    return read(spark, sf, "documents").select("doc_id", X.extract_otsl(text).alias("otsl"))


@query(r"""select doc_id, replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'), chr(39), '"') as text from documents""")
def tidy_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.tidy(F.col("text")).alias("text"))


@query(r"select page_id, regexp_replace(html, '>\s+<', '><', 'g') html from pages")
def html_ws_collapse(spark, sf):
    return read(spark, sf, "pages").select("page_id", H.collapse(F.col("html")).alias("html"))


@query("select p_partkey, case when p_type like 'ECONOMY%' then 'image' when p_type like 'PROMO%' then 'table' else p_type end kind from (select p_partkey, p_type from part)")
def layout_type_map(spark, sf):
    raw = F.when(F.col("p_type").startswith("ECONOMY"), "diagram_timing").when(F.col("p_type").startswith("PROMO"), "table").otherwise(F.col("p_type"))
    return read(spark, sf, "part").select("p_partkey", X.layout_type(raw).alias("kind"))


@query("select p_partkey, regexp_extract(p_brand, '\\d+') n, regexp_extract(p_name, '\\d+') none from part")
def first_integer(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.first_integer(F.col("p_brand")).alias("n"), X.first_integer(F.col("p_name")).alias("none"))


@query("select c_custkey, c_name from customer")
def repeated_phrase(spark, sf):
    thrice = F.concat_ws(" ", "c_name", "c_name", F.replace("c_name", F.lit("#"), F.lit("# ")))
    return read(spark, sf, "customer").select("c_custkey", X.first_period(thrice).alias("c_name"))


# --- numbers and boxes


@query("""with s as (select p_partkey, p_size * 37 w, p_partkey % 900 + 200 h from part),
b as (select *, greatest(28, round_even(w / 28, 0) * 28) w1, greatest(28, round_even(h / 28, 0) * 28) h1, sqrt(w * h / 12845056) shrink, sqrt(3136 / (w * h)) grow from s)
select p_partkey, case when w1 * h1 > 12845056 then greatest(28, floor(w / shrink / 28) * 28) when w1 * h1 < 3136 then ceil(w * grow / 28) * 28 else w1 end::int width,
  case when w1 * h1 > 12845056 then greatest(28, floor(h / shrink / 28) * 28) when w1 * h1 < 3136 then ceil(h * grow / 28) * 28 else h1 end::int height from b""")
def smart_resize(spark, sf):
    s = read(spark, sf, "part").selectExpr("p_partkey", "p_size * 37 as w", "cast(p_partkey % 900 + 200 as int) as h")
    return s.select("p_partkey", G.smart_resize(F.col("w"), F.col("h")).alias("r")).select("p_partkey", "r.width", "r.height")


@query("select l_orderkey, l_linenumber, round_even(l_discount * 640, 0)::int x1, round_even(l_tax * 480, 0)::int y1, round_even((l_discount + 0.3) * 640, 0)::int x2, round_even((l_tax + 0.3) * 480, 0)::int y2 from lineitem")
def denormalize_bbox(spark, sf):
    box = G.denormalize_box(F.array("l_discount", "l_tax", F.col("l_discount") + 0.3, F.col("l_tax") + 0.3), F.lit(640), F.lit(480))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"with {BOXES_SQL} select page, box_id, case when x1 < x2 and y1 < y2 then greatest(0, least(1, x1 / 600)) else 0 end a, case when x1 < x2 and y1 < y2 then greatest(0, least(1, y2 / 400)) else 0 end b from boxes")
def clamp_bbox(spark, sf):
    n = G.normalize(*map(F.col, ("x1", "y1", "x2", "y2")), F.lit(600), F.lit(400))
    return boxes(spark, sf).select("page", "box_id", n.alias("n")).select("page", "box_id", F.col("n")[0].alias("a"), F.col("n")[3].alias("b"))


@query(f"with {BOXES_SQL} select page, box_id, least(x1, x2) l, least(y1, y2) t, greatest(x1, x2) r, greatest(y1, y2) b from boxes")
def quad_to_ltrb(spark, sf):
    q = G.quad_to_box(F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"))
    return boxes(spark, sf).select("page", "box_id", q.alias("q")).select("page", "box_id", *[F.col("q")[i].alias(n) for i, n in enumerate("ltrb")])


@query("select p_partkey, floor(w * f)::int width, floor(h * f)::int height from (select p_partkey, p_size * 97 w, 1500 h, least(1.0::double, 2048.0::double / (p_size * 97), 2048.0::double / 1500) f from part)")
def fit_longest_side(spark, sf):
    return read(spark, sf, "part").select("p_partkey", G.fit_longest(F.col("p_size") * 97, F.lit(1500)).alias("r")).select("p_partkey", "r.*")


@query("select p_partkey, least(floor((p_size - 1) / 49 * 3), 2)::int bin from part")
def equal_width_bin(spark, sf):
    return read(spark, sf, "part").select("p_partkey", G.equal_bin(F.col("p_size"), F.lit(1), F.lit(50), 3).alias("bin"))


# --- label trees, tables, chat


_LABEL = """'{"item":[{"nm":{"<|value|>":"' || p_name || '","<|bbox|>":[0.1,0.2,0.3,0.4]},"cnt":null},{"nm":null}],"total":' || case when p_size % 2 = 0 then 'null' else '{"<|value|>":"' || p_size || '","<|bbox|>":[]}' end || '}'"""


def _labels(spark, sf) -> DataFrame:
    return H.spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.expr(_LABEL.replace("p_size ||", "cast(p_size as string) ||")).alias("label"))


_BOX = '{"<|value|>":"\' || p_name || \'","<|bbox|>":[0.1,0.2,0.3,0.4]}'


@query(f"""select p_partkey, '{{"item":[{{"nm":{_BOX}}},{{}}]' || case when p_size % 2 = 0 then '' else ',"total":{{"<|value|>":"' || p_size || '","<|bbox|>":[]}}' end || '}}' label from part""")
def json_remove_none(spark, sf):
    return _labels(spark, sf).select("p_partkey", J.json_remove_none("label").alias("label"))


@query(f"""select p_partkey, '{{"item":[{{"nm":{_BOX.replace(",0.2,0.3,0.4", "")},"cnt":null}}],"total":' || case when p_size % 2 = 0 then 'null' else '{{"<|value|>":"' || p_size || '","<|bbox|>":[]}}' end || '}}' label from part""")
def json_truncate_lists(spark, sf):
    return _labels(spark, sf).select("p_partkey", J.json_truncate_lists("label").alias("label"))


@query("""select p_partkey, '{"item":[{"nm":{"<|value|>":"","<|bbox|>":[]}}]' || case when p_size % 2 = 0 then '' else ',"total":{"<|value|>":"","<|bbox|>":[]}' end || '}' label from part""")
def json_target_schema(spark, sf):
    return _labels(spark, sf).select("p_partkey", J.json_target_schema("label").alias("label"))


@query("select p_partkey, 'nm' as \"key\", p_name as \"value\", 0.3::double x2 from part")
def json_key_boxes(spark, sf):
    return _labels(spark, sf).select("p_partkey", F.explode(J.json_key_boxes("label")).alias("k")).select("p_partkey", "k.key", "k.value", F.col("k.bbox")[2].alias("x2"))


_TABLE = "'<p>x</p> <table border=\"1\"><caption>c</caption> <tr><td rowspan=\"1\">' || o_orderpriority || '</td> <td><table> <tr><td>' || o_orderkey || '</td></tr></table></td></tr></table><table></table>'"


@query("select o_orderkey, '<table><tr><td>' || o_orderkey || '</td></tr></table>' inner_table, '<table><tr><td>' || o_orderpriority || '</td><td></td></tr></table>' outer_table, 2 n from orders")
def table_extract(spark, sf):
    html = F.expr(_TABLE.replace("|| o_orderkey ||", "|| cast(o_orderkey as string) ||"))
    t = H.spread(read(spark, sf, "orders")).select("o_orderkey", H.tables_of(html).alias("t"))
    return t.select("o_orderkey", F.col("t")[0].alias("inner_table"), F.col("t")[1].alias("outer_table"), F.size("t").alias("n"))


@query("select o_orderkey, '<otsl><fcel>' || o_orderpriority || '<lcel><nl><ecel><fcel>' || o_orderstatus || '<nl></otsl>' otsl from orders")
def html_to_otsl(spark, sf):
    html = F.expr("'<table><tr><th colspan=\"2\">' || o_orderpriority || '</th></tr><tr><td></td><td>' || o_orderstatus || '</td></tr></table>'")
    return H.spread(read(spark, sf, "orders")).select("o_orderkey", H.otsl_of(html).alias("otsl"))


@query("select o_orderkey, '<table a><caption>' || o_orderpriority || '</caption><tr></tr></table>' html from orders")
def table_caption(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", H.with_caption(F.lit("<table a><tr></tr></table>"), F.col("o_orderpriority")).alias("html"))


@query("select p_partkey, '<otsl><fcel>' || p_name || '<ecel><fcel>' || p_brand || '</otsl>' doctags from part")
def otsl_weave(spark, sf):
    tokens = F.array(*map(F.lit, ("fcel", "ecel", "fcel", "nl", "fcel")))
    cells = F.array(F.array(F.lit("<b>"), "p_name", F.lit("</b>")), F.array(F.lit("<i>"), F.lit("</i>")), F.array("p_brand"))
    return read(spark, sf, "part").select("p_partkey", J.weave_otsl(tokens, cells).alias("doctags"))


@query("""with t as (select conv_id, list(text order by turn) filter (role = 'user') q, list(text order by turn) filter (role = 'assistant') a from conversations group by 1),
p as (select *, least(coalesce(len(q), 0), coalesce(len(a), 0)) n from t)
select conv_id, (2 * n)::int turns, case when n > 0 then '<image>' || q[1] end as \"first\", case when n > 0 then a[n] end as \"last\" from p""")
def chat_messages(spark, sf):
    c = read(spark, sf, "conversations")
    side = lambda r: F.transform(F.filter("r", lambda x: x["role"] == r), lambda x: x["text"])
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    m = g.select("conv_id", J.chat(F.array(F.lit("a.jpg")), side("user"), side("assistant"))["messages"].alias("m"))
    return m.select("conv_id", F.size("m").alias("turns"), F.try_element_at("m", F.lit(1))["content"].alias("first"), F.try_element_at("m", F.lit(-1))["content"].alias("last"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'missing lang' when c_nationkey % 2 = 0 then 'value src' end error from customer")
def schema_validation(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", "en").alias("lang"), F.when(F.col("c_nationkey") % 2 == 0, "fake").otherwise("real").alias("src"))
    return SC.check_rows(df, SC.DEFAULT["tasks"]["ocr"]).select("c_custkey", "error")


import loomlake.queries_lake  # noqa: E402,F401 - they register theirs
import loomlake.queries_more  # noqa: E402,F401
import loomlake.queries_rows  # noqa: E402,F401
