"""Queries that take whole tables and whole texts."""

SF = "/root/testdata/sf0.001"


def test_searches_find_long_documents(spark):
    from loomlake.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = {r.h for r in docs.where("n_chars > 2000").selectExpr("sha2(text, 256) h").collect()}
    for name in ("search_json_array_text", "search_valid_content", "search_variants_union"):
        assert any(r["hash"] in long for r in QUERIES[name](spark, SF).collect()), name


def test_texts_are_whole(spark):
    from loomlake.queries import QUERIES

    for name, column, cut in (("tidy_text", "text", 300), ("extract_otsl", "otsl", 60)):
        assert any(len(r[column] or "") > cut for r in QUERIES[name](spark, SF).collect()), name


def test_every_part_is_assigned(spark):
    from loomlake.queries import QUERIES

    parts = spark.read.parquet(f"{SF}/part.parquet")
    rows = QUERIES["greedy_cer_assignment"](spark, SF).collect()
    assert sorted(r.pos for r in rows) == sorted(r.p_partkey for r in parts.select("p_partkey").collect())
    assert sorted(r.text for r in rows) == sorted(r.p_name for r in parts.collect())


def test_all_customers_are_joined(spark):
    from loomlake.queries import QUERIES

    rows = QUERIES["image_annotations_join"](spark, SF).collect()
    assert sum(r.n_customers for r in rows) == spark.read.parquet(f"{SF}/customer.parquet").count()
