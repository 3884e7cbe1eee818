"""License scan by diagonal voting, in DataFrame operations only.

Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond ASCII. The rolling hashes of the word k-grams
of every whole text (k is 2 and 4) are joined to the positions of the templates' k-grams, a fixed list that is broadcast:
its size does not depend on the input. Base phrases and notices of fewer than ``LONG`` words have pairs, licence texts
four-word grams. A hit compares the words themselves too, and votes for the diagonal "position in the text minus position
in the template". Votes are gathered for each diagonal as the set of template positions; neighbouring diagonals (words put
in or left out) are merged; a merged span is verified by its alignment: the share of the template's words that its grams
cover on these diagonals. Labels take a share of ``least``, notices, which differ in a word, of ``least_short``; the score is the best share, so parts of a text show in it. A
base phrase must have all its pairs on one diagonal, that is, stand there word for word.

Null and empty texts have no words, no places and score 0. Each input row gives one row; repeated rows are counted before
the shuffle and give equal rows; ties of spans do not occur, as each has its own diagonals; very long texts are whole; an
empty table gives an empty table. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.license_texts import TEMPLATES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

GAP = 2
#: Shares of words that licence texts and notices of fewer than LONG words need.
LEAST, LEAST_SHORT = 0.75, 0.9
LONG = 12
_ROWS = "template int, label string, is_base boolean, n_words int, k int, place int, t0 string, t1 string, t2 string, t3 string"


def template_rows(base: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """(template, label, is base, number of words, k, position, k words, filled up with None) of every gram of every template."""
    out = []
    for t, (text, label, is_base) in enumerate([*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in templates.items())]):
        own = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        if len(own) < 2:
            raise ValueError(f"a template has two words at least: {text}")
        k = 2 if is_base or len(own) < LONG else 4
        out += [(t, label, is_base, len(own), k, i, *own[i : i + k], *[None] * (4 - k)) for i in range(len(own) - k + 1)]
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan_spans(df: DataFrame, base=BASE, templates=TEMPLATES, gap: int = GAP, least: float = LEAST, least_short: float = LEAST_SHORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, copies, template, label, is_base, start, end, share, verified): spans, [start, end) in
    words, of base phrases the verified ones only; one row without a template for each document."""
    grams = df.sparkSession.createDataFrame(template_rows(base, templates), _ROWS)
    grams = F.broadcast(grams.withColumn("h", F.when(F.col("k") == 2, F.xxhash64("t0", "t1")).otherwise(F.xxhash64("t0", "t1", "t2", "t3"))))
    key = ["doc_id", "text_hash"]
    behind = [F.slice("w", F.lit(i + 1), F.size("w")).alias(f"w{i}") for i in (1, 2, 3)]
    rows = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
        # a row at 0 stands for the document itself
        .select(*key, F.size("w").alias("n_words"), F.concat(F.array(F.lit("")), "w").alias("w"))
        .select(*key, "n_words", F.posexplode(F.arrays_zip(F.col("w").alias("w0"), *behind)).alias("pos", "p"))
        .select(*key, "n_words", "pos", *[f"p.w{i}" for i in range(4)])
        .select("*", F.posexplode(F.array(F.xxhash64("w0", "w1"), F.xxhash64("w0", "w1", "w2", "w3"))).alias("which", "h"))
    )
    same = (rows.h == grams.h) & (rows.w0 == grams.t0) & (rows.w1 == grams.t1) & ((grams.k == 2) | ((rows.w2 == grams.t2) & (rows.w3 == grams.t3)))
    hits = rows.join(grams, same, "left").where("pos = 0 and which = 0 or template is not null")
    about = [F.max(c).alias(c) for c in ("label", "is_base", "k")]
    each = hits.select(*key, rows.n_words.alias("size"), "template", "label", "is_base", "k", grams.n_words.alias("n_template"), (F.col("pos") - 1 - F.col("place")).alias("diagonal"), "place")
    votes = each.groupBy(*key, "template", "diagonal").agg(F.collect_set("place").alias("places"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("n_template").alias("n_template"), *about)
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= gap
    merged = (
        votes.withColumn("new", F.when(F.coalesce(near, F.lit(False)) & ~F.col("is_base"), 0).otherwise(1))
        .withColumn("span", F.sum("new").over(along))
        .groupBy(*key, "template", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.max("copies").alias("copies"), F.max("size").alias("n_words"), F.max("n_template").alias("n_template"), *about)
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    return merged.select(
        *key, "n_words", F.when(F.col("template").isNull(), F.col("copies")).alias("copies"), "template", "label", "is_base",
        F.greatest("low", F.lit(0)).alias("start"), F.least(F.col("high") + F.col("n_template"), F.col("n_words")).alias("end"), (covered / F.col("n_template")).alias("share"), (F.col("n_template") >= LONG).alias("long"),
    ).withColumn("verified", F.when(F.col("is_base"), F.col("share") == 1).when(F.col("long"), F.col("share") >= least).otherwise(F.col("share") >= least_short)).where("template is null or verified or not is_base")


def scan(df: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans) of each row of df."""
    spans = scan_spans(df, **options)
    at = F.when(F.col("is_base"), F.col("start"))
    label = F.when(F.col("verified"), F.col("label"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.count(at).alias("n_base"),
        F.min(at).cast("long").alias("first_word"), F.max(at).cast("long").alias("last_word"),
        names(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), names(label).alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"), F.count(F.when(F.col("verified") & ~F.col("is_base"), 1)).alias("n_spans"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies", "text_hash")


def oracle_sql(base=BASE, templates=TEMPLATES, gap: int = GAP, least: float = LEAST, least_short: float = LEAST_SHORT) -> str:
    literal = lambda v: "null" if v is None else str(int(v)) if isinstance(v, (bool, int)) else f"'{v}'"
    rows = ", ".join(f"({', '.join(map(literal, r))})" for r in template_rows(base, templates))
    return rf"""
with t(template, label, is_base, n_words, k, place, t0, t1, t2, t3) as (values {rows}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
p as (select doc_id, w[i] w0, w[i + 1] w1, w[i + 2] w2, w[i + 3] w3, i - 1 pos from (select doc_id, w, unnest(range(1, len(w))) i from d)),
v as (select doc_id, template, pos - place diagonal, list(distinct place) places, any_value(label) label,
        any_value(is_base) is_base, any_value(k) k, any_value(n_words) n_template
      from p join t on w0 = t0 and w1 = t1 and (k = 2 or w2 = t2 and w3 = t3) group by all),
n as (select *, case when is_base = 0 and diagonal - lag(diagonal) over a <= {gap} then 0 else 1 end new
      from v window a as (partition by doc_id, template order by diagonal)),
s as (select *, sum(new) over (partition by doc_id, template order by diagonal) span from n),
m as (select doc_id, template, span, flatten(list(places)) places, any_value(k) k, any_value(n_template) n_template, min(diagonal) low,
        any_value(label) label, any_value(is_base) is_base from s group by doc_id, template, span),
c as (select *, greatest(low, 0) start, len(list_distinct(flatten(list_transform(places, lambda x: range(x, x + k))))) / n_template share from m),
k as (select *, share >= case when n_template >= {LONG} then {least} else {least_short} end verified from c where is_base = 0 or share = 1),
a as (select doc_id, count(*) filter (is_base = 1) n_base, min(start) filter (is_base = 1) first_word,
        max(start) filter (is_base = 1) last_word, string_agg(distinct label, ',' order by label) filter (is_base = 1) base_labels,
        string_agg(distinct label, ',' order by label) filter (verified) labels, max(share) score, count(*) filter (is_base = 0 and verified) n_spans
      from k group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word,
  last_word::bigint last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  coalesce(score, 0)::double score, coalesce(n_spans, 0)::bigint n_spans
from d left join a on d.doc_id = a.doc_id"""
