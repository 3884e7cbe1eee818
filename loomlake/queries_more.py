"""Queries of archives, image headers, templates, turned lines and pages of many boxes, and the same in SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from loomlake.functions import jsontree as J
from loomlake.functions import text as X
from loomlake.functions.tables import spread
from loomlake.functions.template import compiled
from loomlake.operators import joins as JN
from loomlake.operators.lines import CORNERS, line_walk
from loomlake.plans.testviews import LINES_SQL, lines, read
from loomlake.queries import query
from loomlake.sources import archives, images
from loomlake.sources.files import located
from loomlake.sources.scratch import folder


@query("select p_brand archive, 'p_' || p_size || '/' || p_partkey || '.txt' \"name\", p_name || chr(10) || p_type content from part where p_brand like '%1'")
def zip_members(spark, sf):
    """Archives of parts, one for each brand, and the contents of those whose name ends in 1."""
    to = folder(spark)

    def pack(frame):
        files, base = located(to)
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(zip(frame["name"], frame["text"])):
                z.writestr(name, text)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{frame['p_brand'].iloc[0]}.zip") as out:
            out.write(buf.getvalue())
        return frame[["p_brand"]].head(1)

    parts = read(spark, sf, "part").select("p_brand", F.format_string("p_%d/%d.txt", "p_size", "p_partkey").alias("name"), F.concat_ws("\n", "p_name", "p_type").alias("text"))
    parts.groupBy("p_brand").applyInPandas(pack, "p_brand string").write.format("noop").mode("overwrite").save()
    members = archives.zip_members(spark, to).where(F.endswith("archive", F.lit("1.zip")))
    return archives.member_contents(members).select(F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive"), "name", F.col("content").cast("string").alias("content"))


@query("""select p_partkey, case when p_size % 5 = 0 then null else case p_size % 2 when 0 then 'PNG' else 'GIF' end end format,
  case when p_size % 5 = 0 then null else 100 + p_size end width, case when p_size % 5 = 0 then null else p_partkey % 5000 + 1 end height, p_size % 5 <> 0 valid from part""")
def image_headers(spark, sf):
    """Parts as pictures: GIF and PNG by size, every fifth size cut short."""
    little = lambda c: F.concat(F.expr(f"substr(hex({c} % 256 + 256), 2)"), F.expr(f"substr(hex(floor({c} / 256) + 256), 2)"))
    gif = F.concat(F.lit("474946383961"), little("w"), little("h"), F.lit("000000"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("w"), 8, "0"), F.lpad(F.hex("h"), 8, "0"), F.lit("0802000000"), F.lit("00000000"))
    d = read(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_size") + 100).cast("long").alias("w"), (F.col("p_partkey") % 5000 + 1).alias("h"))
    data = F.when(F.col("p_size") % 5 == 0, F.lit("474946383961")).when(F.col("p_size") % 2 == 0, png).otherwise(gif)
    d = d.withColumn("header", images.header_of(F.unhex(data)))
    return d.select("p_partkey", "header.format", "header.width", F.col("header.height").cast("long").alias("height"), F.col("header.error").isNull().alias("valid"))


TEMPLATE = """Suppliers of {{ r_name }}:
{% for n in nations %}{{ loop.index }}. {{ n.name | lower }}{% if n.suppliers %}:{% for s in n.suppliers %} {{ s.s_name }}{% if s.s_acctbal < 0 %} (debt){% elif loop.last %}.{% else %},{% endif %}{% endfor %}{% else %}: none{% endif %}
{% endfor %}"""


@query("""with s as (select s_nationkey, string_agg(' ' || s_name || case when s_acctbal < 0 then ' (debt)' when k = c then '.' else ',' end, '' order by k) t from
    (select *, row_number() over (partition by s_nationkey order by s_suppkey) k, count(*) over (partition by s_nationkey) c from supplier) group by 1),
  n as (select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) || '. ' || lower(n_name) || ':' || coalesce(t, ' none') || chr(10) l, n_nationkey from nation left join s on s_nationkey = n_nationkey)
select r_regionkey, 'Suppliers of ' || r_name || ':' || chr(10) || string_agg(l, '' order by n_nationkey) prompt from region join n on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def prompt_nested(spark, sf):
    """A template with nested loops, conditions and an else."""
    s = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("suppliers"))
    n = read(spark, sf, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"), "suppliers"))).alias("nations"))
    d = read(spark, sf, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("r_regionkey", compiled(TEMPLATE, d.schema).alias("prompt"))


@query()
def turned_lines(spark, sf):
    """Line items as words of pages, each order turned by its own angle: lines and places of the words. tests/test_lines.py
    holds the walk against pixels."""
    d = lines(spark, sf).selectExpr("l_orderkey as page", "l_linenumber as word_id", "(l_partkey % 8) * 60 + 100 as x", "(l_suppkey % 6) * 40 + 100 as y", "cast(l_quantity as int) + 10 as w", "radians(l_orderkey % 61 - 30) as a")
    corner = lambda dx, dy, k: F.expr(f"cos(a) * (x + {dx} - 400) - sin(a) * (y + {dy} - 300) + 400" if k == "x" else f"sin(a) * (x + {dx} - 400) + cos(a) * (y + {dy} - 300) + 300")
    at = [("0", "0"), ("w", "0"), ("w", "20"), ("0", "20")]
    d = d.select("page", "word_id", *[corner(*at[int(c[1]) - 1], c[0]).alias(c) for c in CORNERS], F.lit(800).alias("width"), F.lit(600).alias("height"))
    return line_walk(d).select("page", "word_id", F.round("angle", 3).alias("angle"), "line", "place")


@query(f"""with {LINES_SQL}, b as (select l_returnflag page, l_orderkey * 10 + l_linenumber word_id, l_partkey % 1000 * 20 x1, l_orderkey % 5000 * 30 y1, l_partkey % 1000 * 20 + 15 x2, l_orderkey % 5000 * 30 + 20 y2 from lines),
  s as (select p_partkey shape_id, p_partkey % 1000 * 20 - p_size s_x1, p_partkey % 1000 * 20 + 13 s_x2 from part where p_size % 7 = 0)
select page, word_id, min(case when (least(x2, s_x2) - greatest(x1, s_x1)) * 20 > 0.85 * 15 * 20 then shape_id end) shape_id from b left join s on s_x1 < x2 and x1 < s_x2 group by 1, 2""")
def crowded_pages(spark, sf):
    """Line items as words of three pages, one for each return flag, and parts as columns on each page."""
    d = lines(spark, sf).selectExpr("l_returnflag as page", "l_orderkey * 10 + l_linenumber as word_id", "l_partkey % 1000 * 20 as x1", "l_orderkey % 5000 * 30 as y1", "l_partkey % 1000 * 20 + 15 as x2", "l_orderkey % 5000 * 30 + 20 as y2")
    s = read(spark, sf, "part").where("p_size % 7 = 0").selectExpr("explode(array('A', 'N', 'R')) as page", "p_partkey as shape_id", "p_partkey % 1000 * 20 - p_size as s_x1", "-100 as s_y1", "p_partkey % 1000 * 20 + 13 as s_x2", "200000 as s_y2")
    return JN.first_container(d, s).select("page", "word_id", "shape_id")


@query("""select o_orderkey, to_json({'items': list({'amount': l_quantity::int::varchar, 'date': l_returnflag, 'ref': l_linenumber::varchar} order by l_linenumber, l_quantity, l_returnflag), 'total': o_orderpriority})::varchar label
from lineitem join orders on l_orderkey = o_orderkey group by o_orderkey, o_orderpriority""")
def invoice_items(spark, sf):
    """Orders as bank statements, restructured."""
    rows = F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(rows)).alias("r"))
    t = F.transform("r", lambda x: F.struct(x["q"].alias("Amount"), x["l_returnflag"].alias("Date"), x["l_linenumber"].alias("Ref"), F.lit("x").alias("More")))
    d = read(spark, sf, "orders").join(g, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.select("o_orderkey", J.invoice(F.to_json(F.struct(F.col("o_orderpriority").alias("Closing Balance"), t.alias("Transactions")))).alias("label"))


@query("""select s_suppkey, case s_nationkey % 10 when 1 then 'title' when 2 then 'title' when 3 then 'text_plain' when 4 then 'list_item' when 5 then 'table' when 6 then 'chart' when 7 then 'digram' when 8 then 'picture' when 9 then 'figure' end office,
  case s_suppkey % 4 when 0 then 'subtitle' when 1 then 'table' else case s_nationkey % 3 when 0 then 'text' when 1 then 'chart' end end slide from supplier""")
def office_and_slide_types(spark, sf):
    codes = F.array(*map(F.lit, ["none", "T01", "T02", "T03", "T04", "V01", "V02", "V03", "V04", "V05"]))
    placeholder = F.element_at(F.array(*map(F.lit, ["SUBTITLE", "TABLE", "BODY", "none"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    shape = F.element_at(F.array(*map(F.lit, ["TEXT_BOX", "CHART", "LINE"])), F.col("s_nationkey") % 3 + 1)
    d = read(spark, sf, "supplier")
    return d.select("s_suppkey", X.office_type(codes[F.col("s_nationkey") % 10]).alias("office"), X.slide_type(placeholder, shape).alias("slide"))


@query("""select p_partkey, '{"name":{"<|value|>":"' || p_name || '"},"sub":[{"name":null,"cnt":{"<|value|>":"' || case when p_size % 3 = 0 then '' else p_size::varchar end || '","<|bbox|>":[1]}}],"cnt":4}' label from part""")
def json_counts(spark, sf):
    """Receipt labels: short names written out, counts cut to their number."""
    count = F.when(F.col("p_size") % 3 == 0, "some").otherwise(F.concat(F.lit("x "), "p_size", F.lit(" pcs 77")))
    label = F.concat(F.lit('{"nm":{"<|value|>":"'), "p_name", F.lit('"},"sub":[{"nm":null,"cnt":{"<|value|>":"'), count, F.lit('","<|bbox|>":[1]}}],"cnt":4}'))
    return spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", J.json_name_and_count(J.required(label)).alias("label"))
