"""Exports to chat format: catalogue rows in, rows of messages and images out (sinks.write_chat_jsonl writes them)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import jsontree as J
from loomlake.functions.geometry import smart_resize
from loomlake.functions.text import PROMPTS, layout_type, prompt
from loomlake.operators.aggregates import grouped_lists
from loomlake.operators.search import in_charset, without_backslash
from loomlake.operators.windows import fixed_groups


def to_chat(df: DataFrame, path: str = "path", query: str = "query", label: str = "label") -> DataFrame:
    """Scalars or lists of queries and labels."""
    array = lambda c: F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(c)
    return df.select(J.chat(array(path), array(query), array(label)).alias("c")).select("c.*")


def kie(df: DataFrame, bbox: bool = True) -> DataFrame:
    """df (path, width, height, label): boxes in pixels of the resized image, the query holds the empty structure."""
    size = smart_resize(F.col("width"), F.col("height"))
    head = PROMPTS["base_kie_bbox" if bbox else "base_kie_no_bbox"] + "\n"
    source = F.col("label") if bbox else J.json_remove_bbox("label")
    answer = J.json_denormalize(source, size["width"], size["height"]) if bbox else J.json_remove_none(source)
    return to_chat(df.select("path", F.concat(F.lit(head), J.json_target_schema(source)).alias("query"), answer.alias("label")))


def layout(df: DataFrame) -> DataFrame:
    """df (path, width, height, label): consolidated elements with boxes in pixels of the resized image."""
    size = smart_resize(F.col("width"), F.col("height"))
    text = F.when(F.coalesce(F.get_json_object("label", "$.reading_order").cast("boolean"), F.lit(False)), PROMPTS["base_layout_reading_order"]).otherwise(PROMPTS["base_layout_no_reading_order"])
    return to_chat(df.select("path", text.alias("query"), J.elements(F.col("label"), (size["width"], size["height"])).alias("label")))


def vqa(df: DataFrame, order: str) -> DataFrame:
    """df (path, query, label): one conversation for each image."""
    return to_chat(grouped_lists(df, "path", order, ["query", "label"]))


def otsl(df: DataFrame, max_tags: int | None = None) -> DataFrame:
    """df (path, label): tables as OTSL; null labels and backslashes are left out."""
    from loomlake.functions.text import extract_otsl, tag_count

    out = without_backslash(df.where("label is not null")).withColumn("label", F.coalesce(extract_otsl(F.col("label")), F.col("label")))
    if max_tags:
        out = out.where(tag_count(F.col("label")) <= max_tags)
    return to_chat(out.withColumn("query", F.lit(PROMPTS["table"])))


def recognition(df: DataFrame, charset: str) -> DataFrame:
    """df (path, label): texts of known characters only."""
    return to_chat(df.where(in_charset(F.col("label"), charset)).withColumn("query", F.lit(PROMPTS["recognition"])))


def paragraphs(df: DataFrame, by: str, order: str, size: int, padding: int = 10) -> DataFrame:
    """df (by, order, path, width, height, label): words grouped to a paragraph's texts, paths and canvas."""
    groups = fixed_groups(df, by, order, size)
    rows = F.array_sort(F.collect_list(F.struct(order, "path", "label")))
    return groups.groupBy(by, "grp").agg(rows.alias("r"), (F.max("width") + 2 * padding).alias("width"), (F.sum("height") + (F.count("*") + 1) * padding).alias("height")).select(by, "grp", F.transform("r", lambda x: x["path"]).alias("paths"), F.array_join(F.transform("r", lambda x: x["label"]), "\n").alias("label"), "width", "height")


def element_crops(df: DataFrame) -> DataFrame:
    """df (path, label): one conversation for each layout element with a value; the crop's name holds its place."""
    parsed = F.from_json("label", "struct<elements:array<struct<idx:int,type:string,value:string,bbox:array<double>>>>")["elements"]
    each = df.select("path", F.posexplode(parsed).alias("pos", "e")).where("e.value <> ''")
    kind = layout_type(F.col("e.type"))
    return to_chat(each.select(F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit("_"), F.col("pos").cast("string"), F.lit(".jpg")).alias("path"), prompt(kind).alias("query"), F.col("e.value").alias("label")))
