"""Queries over functions of rows, arrays and small groups, and the same in SQL."""

from __future__ import annotations

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
from loomlake.plans.testviews import BOXES_SQL, LINES_SQL, SQL, boxes, catalog, lines, read
from loomlake.queries import query

C = f"with {SQL} "


# --- text


@query("select p_partkey, p_brand || '_' || p_partkey || '.v2' path, p_partkey || '.v2' last_id, case when p_size % 2 = 0 then '.pdf' else '' end suffix, 'b/' || p_partkey || case when p_size % 2 = 0 then '.PDF' else '' end tail from part")
def path_tails(spark, sf):
    d = read(spark, sf, "part").selectExpr("p_partkey", "concat(p_brand, '_', p_partkey, '.v2') as path", "concat('/a/b/', p_partkey, if(p_size % 2 = 0, '.PDF', '')) as file")
    named = F.concat(F.lit("/x/y_z/"), "path", F.lit(".json"))
    return d.select("p_partkey", "path", X.last_id(named).alias("last_id"), X.suffix(F.col("file")).alias("suffix"), X.last_parts(F.col("file")).alias("tail"))


_RANGES = "case p_size % 4 when 0 then '[1.5 2' when 1 then '3  4.25]' when 2 then '[7 ul 8]' else p_name end"


@query("select p_partkey, case p_size % 4 when 0 then '[1.5~2]' when 1 then '[3~4.25]' when 2 then '[7 uL 8]' else replace(p_name, 'ul', 'uL') end fixed from part")
def range_repair(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.repair_range(F.expr(_RANGES)).alias("fixed"))


@query("select o_orderkey, o_orderkey % 3 = 0 is_date from orders")
def iso_date_check(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return read(spark, sf, "orders").select("o_orderkey", X.is_iso_date(F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T"))).otherwise("1-2-3")).alias("is_date"))


@query("select c_custkey, 'a ' || c_name || 'b' as text from customer")
def plain_spaces(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", X.plain_spaces(F.concat(F.lit("a　"), "c_name", F.lit("​" + "b"))).alias("text"))


@query("select event_id, case when event_id % 4 = 0 then 'at ' || event_type else strftime(ts, '%m-%d %H:%M') end short from events")
def short_time(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf, "events").select("event_id", X.short_time(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("at "), "event_type")).otherwise(iso)).alias("short"))


@query("select page_id, case when page_id % 2 = 0 then 'img/' || page_id || '.jpg' else '' end path from pages")
def image_path_of_url(spark, sf):
    url = F.expr("if(page_id % 2 = 0, concat('http://h/?x=1&d=/store/img/', page_id, '.jpg&y=2'), url)")
    return read(spark, sf, "pages").select("page_id", X.image_path_of_url(url, "/store/").alias("path"))


@query("select p_partkey, case p_size % 3 when 0 then 'Read text in the image.' when 1 then 'Parse the table in the image.' end prompt from part")
def prompt_map(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "recognition").when(F.col("p_size") % 3 == 1, "table").otherwise("none such")
    return read(spark, sf, "part").select("p_partkey", X.prompt(kind).alias("prompt"))


# Fixed values, written down a second time: the exported class of each raw layout type.
_LAYOUT_KINDS = """case when raw in ('text_plain', 'text_plane', 'title', 'section_header', 'list_item', 'caption', 'page_header', 'page_footer', 'abstract', 'keywords', 'footnote', 'handwriting', 'table_of_contents_entry', 'text_inline_math', 'formula', 'music_sheet', 'chemical_formula_content', 'publishing_info', 'signature', 'stamp') then 'plain_text'
  when raw in ('table') then 'table'
  when raw in ('figure', 'picture', 'flowchart', 'chart', 'chart_bar', 'chart_pie', 'chart_line', 'chart_area', 'chart_scatter', 'chart_radar', 'chart_mixed', 'diagram', 'diagram_functional_block', 'diagram_flowchart', 'diagram_characteristic_curve', 'diagram_timing', 'diagram_circuit', 'diagram_3d_schematic', 'diagram_appearance', 'diagram_pin', 'diagram_layout', 'diagram_engineering_drawing', 'diagram_data_structure', 'diagram_sampling', 'diagram_functional_register', 'diagram_marking') then 'image'
  else raw end"""


@query(f"select raw, {_LAYOUT_KINDS} kind from (select unnest([{', '.join(repr(k) for k in X.LAYOUT_TYPES)}]) raw union all select p_type from part)")
def layout_types_all(spark, sf):
    known = spark.createDataFrame([(k,) for k in X.LAYOUT_TYPES], "raw string")
    raw = known.union(read(spark, sf, "part").select("p_type"))
    return raw.select("raw", X.layout_type(F.col("raw")).alias("kind"))


# Fixed values, written down a second time.
@query("""select name, kind from (values ('Caption', 'caption'), ('Footnote', 'footnote'), ('Formula', 'formula'), ('List-item', 'list_item'), ('Page-footer', 'page_footer'), ('Page-header', 'page_header'), ('Picture', 'figure'), ('Section-header', 'section_header'), ('Table', 'table'), ('Text', 'text_plane'), ('Title', 'title')) t(name, kind) union all select n_name, 'other' from nation""")
def document_classes(spark, sf):
    names = spark.createDataFrame([(k,) for k in X.DOCUMENT_CLASSES], "name string").union(read(spark, sf, "nation").select("n_name"))
    return names.select("name", X.document_class(F.col("name")).alias("kind"))


@query("select conv_id, 'Find:' || coalesce(string_agg(chr(10) || '- ' || role, '' order by role), '') || chr(10) || 'as JSON' prompt from (select distinct conv_id, role from conversations) group by conv_id")
def prompt_template(spark, sf):
    g = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return g.select("conv_id", X.template("Find:", F.col("roles"), "\nas JSON").alias("prompt"))


@query("select doc_id, sha256(coalesce(text, '')) digest, octet_length(encode(coalesce(text, ''))) n_bytes from documents")
def asset_digest(spark, sf):
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return read(spark, sf, "documents").select("doc_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes"))


# --- columns, filters, lists


@query("select c_custkey \"key\", c_name \"label\", 'ko' lang, 'real' src from customer")
def upload_columns(spark, sf):
    d = read(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as caption", "'x' as uploaded_by", "'y' as file_id", "'z' as lang")
    return SR.append_constants(SR.rename_first(SR.without_reserved(d, {"lang": "ko", "src": "real"}), ["text", "caption"], "label"), {"lang": "ko", "src": "real"})


@query(C + "select row_id, path from catalog where provider = 'docs' and path in (select path from catalog where dataset = 'src3' or provider = 'web')")
def existing_paths(spark, sf):
    d = catalog(spark, sf)
    return SR.existing_paths(d.where("provider = 'docs'"), d.where("dataset = 'src3' or provider = 'web'")).select("row_id", "path")


@query("select p_partkey from part where p_size >= 25 and not (p_retailprice > 1200 and p_size > 40)")
def numeric_filter(spark, sf):
    d = read(spark, sf, "part")
    return SR.within(d, p_size=(25, None)).where(~(SR.bounds("p_retailprice", above=1200) & SR.bounds("p_size", above=40))).select("p_partkey")


@query("select o_custkey, min(o_orderkey) single from orders group by 1 having count(*) = 1")
def single_element(spark, sf):
    return A.single_rows(read(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("single"))


@query('''select page_id from pages where contains(html, 'lang="fr"') and not contains(html, 'href="/The"') ''')
def substring_filters(spark, sf):
    return SR.containing(read(spark, sf, "pages"), "html", has=['lang="fr"'], lacks=['href="/The"']).select("page_id")


@query("select url from (select url from pages union select 'http://more/' || n_nationkey from nation)")
def url_union(spark, sf):
    return JN.set_union(read(spark, sf, "pages").select("url"), read(spark, sf, "nation").select(F.concat(F.lit("http://more/"), "n_nationkey").alias("url")))


@query("select s_suppkey, '2024-01-01' date from supplier")
def date_if_absent(spark, sf):
    d = read(spark, sf, "supplier").select("s_suppkey")
    return SR.constant_if_absent(SR.constant_if_absent(d, "date", "2024-01-01"), "date", "1999-01-01")


@query("select o_orderkey from orders order by o_orderkey desc limit 5")
def last_five(spark, sf):
    return S.last_n(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("select n_nationkey, row_number() over (order by sha256(n_nationkey || '-42'), n_nationkey) - 1 place from nation")
def shuffled_order(spark, sf):
    return W.numbered(read(spark, sf, "nation").select("n_nationkey", F.struct(S.draw("n_nationkey"), "n_nationkey").alias("d"), F.lit(0).alias("g")), "g", "d", "place").select("n_nationkey", "place")


@query("""with n as (select doc_id, row_number() over (order by sha256(doc_id || '-42')) k, count(*) over () c from documents)
select doc_id, case when k <= ceil(c * 0.1) then 'test' when k <= ceil(c * 0.1) + ceil((c - ceil(c * 0.1)) * 0.2) then 'validation' else 'train' end split from n""")
def split_three_ways(spark, sf):
    return S.split(read(spark, sf, "documents"), 0.1, "doc_id", validation=0.2).select("doc_id", "split")


# --- groups and joins


@query("select event_type, round(median(value), 9) middle, round(avg(value), 6) mean from events group by event_type")
def median_mean(spark, sf):
    return A.middles(read(spark, sf, "events"), "event_type", "value").select("event_type", F.round("median", 9).alias("middle"), F.round("mean", 6).alias("mean"))


@query(f"with {BOXES_SQL} select a.page, a.box_id, r_name region from boxes a join (select page, box_id, l_partkey % 5 k from boxes) b on a.page = b.page and a.box_id = b.box_id join region on k = r_regionkey")
def composite_lookup(spark, sf):
    b = boxes(spark, sf)
    other = b.selectExpr("page", "box_id", "cast(l_partkey % 5 as int) as r_regionkey").join(F.broadcast(read(spark, sf, "region")), "r_regionkey").selectExpr("page", "box_id", "r_name as region")
    twice = other.withColumn("at", F.lit(2)).unionByName(other.select("page", "box_id", F.lit("old").alias("region"), F.lit(1).alias("at")))
    return JN.composite_lookup(b.select("page", "box_id"), twice, ["page", "box_id"], "at").drop("at")


@query("select o_custkey, max(o_orderkey) last_key, arg_max(o_totalprice, o_orderkey) price from orders group by 1")
def last_of_key(spark, sf):
    return JN.last_by(read(spark, sf, "orders"), ["o_custkey"], "o_orderkey").selectExpr("o_custkey", "o_orderkey as last_key", "o_totalprice as price")


@query("with g as (select s_nationkey, list(s_suppkey order by s_suppkey) k from supplier group by 1) select s_nationkey, array_to_string(case when s_nationkey % 2 = 0 then k else k[1:1] end, ',') kept from g")
def keep_list_or_first(spark, sf):
    g = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("k"))
    return g.select("s_nationkey", F.array_join(J.keep_or_first(F.col("k"), F.col("s_nationkey") % 2 == 0).cast("array<string>"), ",").alias("kept"))


@query("with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 p from conversations) select conv_id, role, length(text) chars, p::int place from r")
def lock_step_explode(spark, sf):
    g = A.grouped_lists(read(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])
    rows = g.withColumn("place", F.transform("role", lambda t, i: i))
    return J.lock_step(rows, "role", "text", "place").select("conv_id", "role", F.length("text").cast("long").alias("chars"), "place")


@query(f"with {LINES_SQL} select l_orderkey, l_suppkey % 3 page, l_linenumber number, l_partkey answer from lines")
def nested_flatten(spark, sf):
    """Orders of pages of lines, built nested and flattened again."""
    b = lines(spark, sf).select("l_orderkey", (F.col("l_suppkey") % 3).alias("page"), F.struct("l_linenumber", "l_partkey").alias("qa"))
    pages = b.groupBy("l_orderkey", "page").agg(F.collect_list("qa").alias("qa_data"))
    docs = pages.groupBy("l_orderkey").agg(F.collect_list(F.struct("page", "qa_data")).alias("pages"))
    return J.flattened(docs, "pages", "qa_data").selectExpr("l_orderkey", "page", "l_linenumber as number", "l_partkey as answer")


@query("with k as (select distinct c_nationkey, c_mktsegment v from customer), s as (select s_nationkey, count(*) c from supplier group by 1) select n_nationkey, (select count(*) from k where c_nationkey = n_nationkey) + (n_nationkey % 2) n from nation")
def append_new_entries(spark, sf):
    g = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("value"), F.lit(1).alias("bbox"))).alias("old"))
    d = read(spark, sf, "nation").join(g, "n_nationkey", "left")
    more = F.when(F.col("n_nationkey") % 2 == 1, F.array(F.struct(F.col("n_name").alias("value"), F.lit(1).alias("bbox")))).otherwise(F.slice(F.coalesce("old", F.array()), 1, 2))
    return d.select("n_nationkey", F.size(J.append_new(F.coalesce("old", F.array()), more)).cast("long").alias("n"))


@query(f"with {LINES_SQL}, k as (select l_orderkey doc_id, l_suppkey % 4 k, 'v' || l_partkey % 3 v from lines), n as (select doc_id, k, count(distinct v) c from k group by all) select k.doc_id, k.k, case when c > 1 then k.k || '::' || v else k.k::varchar end name from k join n on k.doc_id = n.doc_id and k.k = n.k")
def key_names(spark, sf):
    k = lines(spark, sf).selectExpr("l_orderkey as doc_id", "l_suppkey % 4 as k", "concat('v', l_partkey % 3) as v")
    n = k.groupBy("doc_id", "k").agg(F.countDistinct("v").alias("c"))
    return k.join(n, ["doc_id", "k"]).select("doc_id", "k", J.disambiguate(F.col("k").cast("string"), F.col("v"), F.col("c")).alias("name"))


@query()
def column_centres(spark, sf):
    return A.column_centres(boxes(spark, sf).selectExpr("page", "box_id", "cast(x1 as double) as x"), "page", "x")


# --- boxes


@query(f"with {BOXES_SQL} select page, box_id, round(greatest(0, least(1, x1 / 700)), 4) a, round(greatest(0, least(1, (y1 + 9) / 500)), 4) b from boxes")
def xywh_shares(spark, sf):
    n = G.xywh_to_share(F.col("x1"), F.col("y1"), F.lit(5), F.lit(9), 700, 500)
    return boxes(spark, sf).select("page", "box_id", n[0].alias("a"), n[3].alias("b"))


_TURN = "x1 / 10.0::double / 1000 * 100 / 100 * 1000 px, y1 / 10.0::double / 500 * 100 / 100 * 500 py, 4.0::double / 100 * 1000 pw, 6.0::double / 100 * 500 ph, radians(box_id * 15.0::double) t"


@query(f"with {BOXES_SQL}, r as (select page, box_id, {_TURN} from boxes) select page, box_id, round(trunc(least(px, px + pw * cos(t), px - ph * sin(t), px + pw * cos(t) - ph * sin(t)))::int / 1000, 3) a, round(trunc(greatest(py, py + pw * sin(t), py + ph * cos(t), py + pw * sin(t) + ph * cos(t)))::int / 500, 3) b from r")
def rotated_boxes(spark, sf):
    c = lambda v, size: v / F.lit(10.0) / size * 100
    n = G.rotated_to_box(c(F.col("x1"), 1000), c(F.col("y1"), 500), F.lit(4.0), F.lit(6.0), F.col("box_id") * 15, F.lit(1000), F.lit(500))
    return boxes(spark, sf).select("page", "box_id", n[0].alias("a"), n[3].alias("b"))


@query(f"with {BOXES_SQL} select page, box_id, 900 - y2 top, 900 - y1 bottom, round(x1 * 0.48::double, 6) x from boxes")
def flipped_scaled(spark, sf):
    f = G.flip_y(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(900))
    return boxes(spark, sf).select("page", "box_id", f[1].alias("top"), f[3].alias("bottom"), F.round(G.rescale(F.col("x1")), 6).alias("x"))


@query(f"with {BOXES_SQL} select page, box_id, round(case when (x2 - x1) * (y2 - y1) > 0 then greatest(0, least(x2, 500) - greatest(x1, 100)) * greatest(0, least(y2, 400) - greatest(y1, 50)) / ((x2 - x1) * (y2 - y1))::double else 0 end, 9) share from boxes")
def area_shares(spark, sf):
    r = G.area_ratio(*map(F.col, ("x1", "y1", "x2", "y2")), F.lit(100), F.lit(50), F.lit(500), F.lit(400))
    return boxes(spark, sf).select("page", "box_id", F.round(r, 9).alias("share"))


@query(f"with {BOXES_SQL} select page, box_id, round(degrees(atan2(y2 - y1, x2 - x1)), 6) angle, round(x1 * cos(pi() / 6) - y1 * sin(pi() / 6), 4) x, round(x1 * sin(pi() / 6) + y1 * cos(pi() / 6), 4) y from boxes")
def angles(spark, sf):
    r = G.rotate(F.col("x1"), F.col("y1"), F.lit(30.0))
    return boxes(spark, sf).select("page", "box_id", F.round(G.angle(*map(F.col, ("x1", "y1", "x2", "y2"))), 6).alias("angle"), F.round(r["x"], 4).alias("x"), F.round(r["y"], 4).alias("y"))


# --- label trees and tables

_LEAF = """'{"<|value|>":"' || p_name || '","<|bbox|>":[0.5,1]}'"""
_TREE = f"""'{{"item":{{"nm":' || {_LEAF} || '}},"n":' || p_size || ',"none":null}}'"""


def _trees(spark, sf):
    return H.spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", F.expr(_TREE.replace("|| p_size ||", "|| cast(p_size as string) ||")).alias("label"))


@query("""select p_partkey, '{"item":{"nm":{"<|value|>":"' || p_name || '"}},"n":' || p_size || ',"none":null}' bare,
  '{"item":{"name":{"<|value|>":"' || p_name || '","<|bbox|>":[0.5,1]}},"n":' || p_size || ',"none":null}' renamed,
  '{"item":[{"nm":{"<|value|>":"' || p_name || '","<|bbox|>":[0.5,1]}}],"n":' || p_size || ',"none":null}' wrapped,
  '{"item":{"nm":{"<|value|>":"str","<|bbox|>":["float"]}},"n":"int","none":"NoneType"}' kinds from part""")
def json_keys(spark, sf):
    t = _trees(spark, sf)
    return t.select("p_partkey", J.json_remove_bbox("label").alias("bare"), J.json_rename("label").alias("renamed"), J.json_wrap_items("label").alias("wrapped"), J.json_tree_schema("label").alias("kinds"))


@query("""select p_partkey, '{"a":{"<|value|>":"' || p_name || '","<|bbox|>":""},"b":[{"<|value|>":' || p_size || ',"<|bbox|>":""}]}' label from part""")
def json_wrap_values(spark, sf):
    plain = F.concat(F.lit('{"a":"'), "p_name", F.lit('","b":['), F.col("p_size").cast("string"), F.lit("]}"))
    return H.spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", J.json_wrap_values(plain).alias("label"))


@query("""select p_partkey, case p_size % 3 when 0 then '{"a":' || p_size || '}' when 1 then '{"a":["x",null]}' else '{}' end parsed from part""")
def json_safe_parse(spark, sf):
    text = F.expr("case p_size % 3 when 0 then concat('{\"a\": ', cast(p_size as string), '}') when 1 then \"{'a': ('x', None)}\" else concat('{', p_name) end")
    return H.spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", J.json_parse(text).alias("parsed"))


@query("select p_partkey, p_name \"value\", '[1,' || p_size || ']' bbox from part union all select p_partkey, 'z', '' from part")
def value_box_pairs(spark, sf):
    text = F.concat(F.lit('{"k":{"<|value|>": "'), "p_name", F.lit('", "<|bbox|>": "[1,'), F.col("p_size").cast("string"), F.lit(']"},"l":{"<|value|>":"z","<|bbox|>":""}}'))
    return read(spark, sf, "part").select("p_partkey", F.explode(J.pairs_of(text)).alias("x")).select("p_partkey", "x.value", "x.bbox")


@query("""select p_partkey, '[{"type":"plain_text","bbox":[1.0,2.0,3.0,' || p_size || '.0]},{"type":"image","bbox":[0.0,0.0,1.0,1.0]}]' elements from part""")
def element_projection(spark, sf):
    label = F.concat(F.lit('{"page":1,"elements":[{"idx":2,"type":"chart_pie","value":"","bbox":[0,0,1,1]},{"idx":1,"type":"title","value":"x","bbox":[1,2,3,'), F.col("p_size").cast("string"), F.lit("]}]}"))
    return read(spark, sf, "part").select("p_partkey", J.elements(label).alias("elements"))


@query("select o_orderkey, '<table class=\"a\"><tr><td>' || o_orderpriority || '</td></tr></table>' \"first\", '<table>' || o_orderstatus || '</table>' \"last\", 2 n from orders")
def flat_tables(spark, sf):
    html = F.concat(F.lit('x<table class="a"><tr><td>'), "o_orderpriority", F.lit("</td></tr></table> y\n<table>"), "o_orderstatus", F.lit("</table><tabl>"))
    return read(spark, sf, "orders").select("o_orderkey", H.flat_tables(html).alias("t")).select("o_orderkey", F.col("t")[0].alias("first"), F.col("t")[1].alias("last"), F.size("t").alias("n"))


@query("select o_orderkey, '<otsl><fcel>' || o_orderpriority || '<lcel><ecel><nl><ucel><xcel><fcel>a i1i2<nl><fcel>' || o_orderstatus || '<nl></otsl>' otsl from orders")
def nested_html_to_otsl(spark, sf):
    """Row and column spans, a table inside a cell, unclosed tags and a span that is no number."""
    html = F.concat(F.lit('<div><table><thead><tr><th rowspan="2" colspan="2">'), "o_orderpriority", F.lit("</th><th colspan='²'></th></tr></thead><tbody><tr><td>a <table><tr><td>i1</td><td>i2</td></tr></table></td></tr><tr><td>"), "o_orderstatus", F.lit("</td></tr></tbody>"))
    return H.spread(read(spark, sf, "orders")).select("o_orderkey", H.otsl_of(html).alias("otsl"))
