import json

import pytest
from pyspark.sql import functions as F

from loomlake.functions import jsontree as J
from loomlake.functions import text as X
from loomlake.operators import aggregates as A
from loomlake.operators import joins as JN
from loomlake.operators import sampling as S
from loomlake.operators import search as SR
from loomlake.operators import windows as W
from loomlake.plans.lake import Lake


def test_filters(spark):
    df = spark.createDataFrame([(1, "a-b"), (5, "b"), (None, None), (9, "%_")], "x int, t string")
    ids = lambda d: sorted(r.x for r in d.collect() if r.x is not None)
    assert ids(SR.within(df, x=(2, None))) == [5, 9] and ids(SR.within(df, x=(None, 5))) == [1, 5] and SR.within(df).count() == 4
    assert ids(df.where(SR.bounds("x", above=1, below=9))) == [5] and df.where(~SR.bounds("x", least=2)).count() == 2
    assert ids(SR.containing(df, "t", has=["b"], lacks=["-"])) == [5] and ids(SR.containing(df, "t", has=["%_"])) == [9]
    assert [r.x for r in S.first_n(df, "x", 2).collect()] == [1, 5] and [r.x for r in S.last_n(df, "x", 9).collect()] == [9, 5, 1, None]
    assert SR.constant_if_absent(df, "x", 7).columns == ["x", "t"] and SR.constant_if_absent(df, "d", "v").first().d == "v"


def test_groups_and_lookups(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "d")], "k int, o int, v string")
    assert sorted((r.k or 0, r.v) for r in A.single_rows(df, "k", "v").collect()) == [(0, "d"), (2, "c")]
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert sorted(map(tuple, JN.composite_lookup(base, df, ["k"], "o").collect())) == [(1, 2, "b"), (2, 1, "c")]
    with pytest.raises(Exception, match="name an order"):
        JN.composite_lookup(base, df, ["k"]).collect()
    assert JN.set_union(base, base, spark.createDataFrame([(9,)], "k int")).count() == 4
    rows = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, 1), (2, 1)], "a int, b int")
    assert W.all_duplicates(rows, ["a", "b"]).count() == 4
    groups = W.fixed_groups(spark.range(10).selectExpr("if(id < 7, 'x', null) as g", "id"), "g", "id", 2)
    assert sorted((r.g or "", r.id, r.grp) for r in groups.collect()) == [("", 7, 0), ("", 8, 0)] + [("x", i, i // 2) for i in range(6)]
    left, right = spark.range(5).selectExpr("1 as g", "id as a"), spark.range(3).selectExpr("1 as g", "id * 10 as b")
    assert sorted(map(tuple, JN.zip_rows(left, right, ["g"], "a", "b").collect())) == [(1, 0, 0), (1, 1, 10), (1, 2, 20)]


def test_labels(spark):
    df = spark.createDataFrame([(1, [("p", [(1, "x"), (2, "y")]), ("q", [])]), (2, None)], "d int, pages array<struct<page:string,qa:array<struct<n:int,a:string>>>>")
    assert sorted(map(tuple, J.flattened(df, "pages", "qa").collect())) == [(1, "p", 1, "x"), (1, "p", 2, "y")]
    t = spark.createDataFrame([('{"Closing Balance":"9","Transactions":[{"Amount":1.5,"Date":"d","More":2}]}',), ("{}",), ("no",), (None,)], "t string")
    got = [r[0] for r in t.select(J.invoice(F.col("t"))).collect()]
    assert json.loads(got[0]) == {"items": [{"amount": "1.5", "date": "d", "ref": None}], "total": "9"} and json.loads(got[1]) == {"items": [], "total": None} and got[2:] == [None, None]
    assert J.name_and_count({"nm": [{"nm": 1, "cnt": {"<|value|>": "a12 b3"}}], "cnt": {"<|value|>": "none"}}) == {"name": [{"name": 1, "cnt": {"<|value|>": "12"}}], "cnt": {"<|value|>": ""}}
    for bad in ("", "  ", None):
        with pytest.raises(Exception, match="empty label"):
            spark.createDataFrame([(bad,)], "t string").select(J.required(F.col("t"))).collect()
    assert spark.range(1).select(X.slide_type(F.lit("TITLE"), F.lit("CHART")), X.slide_type(F.lit(None), F.lit("CHART")), X.office_type(F.lit("T9"))).first()[:] == ("title", "chart", None)


def test_reupload(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = [(f"p{i}", f"d{i % 3}", "test", "ko", "real", f"label {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "path string, dataset string, provider string, lang string, src string, label string")
    for _ in range(2):
        assert sorted(lake.reupload(df, "ocr", "again")) == ["d0", "d1", "d2"]
        assert lake.ingest.status()["pending"] == 3
    assert lake.ingest.process_pending()["success"] == 3
    assert sorted(map(tuple, lake.partitions().collect())) == [("test", f"d{k}", "ocr", "again", 10) for k in range(3)]
    found = lake.search(datasets="d1")
    assert sorted(r.label for r in found.collect()) == sorted(f"label {i}" for i in range(30) if i % 3 == 1)


def test_catalogue_partition_in_several_tasks(spark, tmp_path):
    """A partition that holds most rows is written by several tasks, each a file, and not by one that grows with it."""
    from loomlake.sources.sinks import write_catalog_partitions

    keys = {"provider": "'a'", "dataset": "if(id % 1000 = 0, 'few', 'many')", "task": "'t'", "variant": "'v'"}
    d = spark.range(400_000).selectExpr("id", "sha2(cast(id as string), 256) as h", *[f"{v} as {k}" for k, v in keys.items()])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        write_catalog_partitions(d, str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "c/provider=a/dataset=many").rglob("*.parquet"))) > 2
    assert spark.read.parquet(str(tmp_path / "c")).selectExpr("count(*)", "count(distinct id)", "count_if(dataset = 'few')").first() == (400_000, 400_000, 400)


def test_slow_work_is_spread(spark, tmp_path):
    """A file of one row group is dealt to tasks that all have rows, though Spark sees several splits."""
    from loomlake.functions.tables import spread

    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        parts = spread(spark.read.parquet(str(tmp_path / "p"))).selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(parts) >= 4 and max(p["count"] for p in parts) < 20_000


def test_composite_lookup_deals_large_tables(spark):
    """More rows than the session's tasks are to sort: tasks by the number of rows, and the same rows."""
    from loomlake.operators.joins import composite_lookup

    left = spark.range(20_000).selectExpr("id div 10 as a", "id % 10 as b")
    other = left.selectExpr("a", "b", "concat('v', a) as v", "1 as at").union(left.selectExpr("a", "b", "'last'", "2"))
    got = composite_lookup(left, other, ["a", "b"], "at", per_task=1_000)
    assert got.rdd.getNumPartitions() == 40
    assert got.selectExpr("count(*)", "count_if(v = 'last')").first() == (20_000, 20_000)
