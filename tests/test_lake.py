"""Uploads through processing, search, download and collections, in a temporary lake."""

import json

import pytest
from pyspark.sql import functions as F

from loomlake.plans import cli, exporters
from loomlake.plans.jobs import JobRegistry
from loomlake.plans.lake import Lake
from loomlake.plans.schema import SchemaRegistry
from loomlake.sources import readers, sinks
from loomlake.streaming.drain import drain_staging, run_available, windowed_counts

META = {"lang": "ko", "src": "real"}


@pytest.fixture()
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def images(spark):
    return spark.createDataFrame([(bytearray(b"one"), "a", ["x"]), (bytearray(b"one"), "b", ["y"]), (None, "c", None), (bytearray(b"two"), "d", [])], "image_bytes binary, label string, tags array<string>")


def test_lifecycle(spark, lake, tmp_path):
    assert lake.upload_raw(images(spark), "test", "d1")
    assert lake.upload_raw(images(spark), "test", "d1") is None
    assert lake.upload_raw(images(spark), "test", "d1", overwrite=True)
    lake.upload_task(spark.createDataFrame([("t", 1)], "label string, width int"), "test", "d1", "ocr", "base", META)
    with pytest.raises(ValueError):
        lake.upload_task(images(spark), "test", "d1", "ocr", "base", {"lang": "xx", "src": "real"})
    assert lake.ingest.status() == {"pending": 2, "processing": 0, "failed": 0}
    job = lake.wait_for_job(lake.trigger_processing(background=False))
    assert job["status"] == "completed" and job["result"]["success"] == 2 and job["result"]["success_rate"] == "100.0%"
    assert lake.ingest.stored().count() == 2
    assert sorted(map(tuple, lake.partitions().collect())) == [("test", "d1", "ocr", "base", 1), ("test", "d1", "raw", "image", 4)]
    found = lake.search(providers=["test"], tasks="raw")
    assert found.columns == ["label", "tags", "hash", "path", "provider", "dataset", "task", "variant"]
    assert {r.tags for r in found.collect()} == {'["x"]', '["y"]', None, "[]"}
    assert lake.search(text_search={"column": "label", "text": "a"}).count() == 1
    full = lake.to_dataset(found, include_images=True)
    assert full.count() == 3 and all(r.path.startswith(str(lake.root)) for r in full.collect())
    assert lake.ingest.validate_assets()["summary"] == {"checked": 3, "missing": 0, "integrity_rate": 100.0}
    next((lake.root / "assets").rglob("*.jpg")).unlink()
    report = lake.ingest.validate_assets()
    assert report["summary"]["missing"] in (1, 2) and len(report["missing_files"]) == 1
    assert not lake.is_stale()
    assert lake.download(found, str(tmp_path / "out.parquet")).endswith(".parquet") and spark.read.parquet(str(tmp_path / "out.parquet")).count() == 4
    with pytest.raises(ValueError):
        lake.download(found, str(tmp_path / "o"), "csv")


def test_one_bad_upload_fails_alone(spark, lake):
    lake.upload_raw(spark.createDataFrame([("x",)], "label string"), "test", "good")
    bad = lake.root / "staging/pending/bad"
    bad.mkdir()
    out = lake.ingest.process_pending()
    assert (out["success"], out["failed"]) == (1, 1)
    assert json.loads((lake.root / "staging/failed/bad/_error.json").read_text())["error"]


def test_files_and_mixed(spark, lake, tmp_path):
    (tmp_path / "f.pdf").write_bytes(b"pdf")
    df = spark.createDataFrame([(str(tmp_path / "f.pdf"), bytearray(b"i"))], "file_path string, image binary")
    lake.upload_raw(df, "test", "mix")
    lake.ingest.process_pending()
    (r,) = lake.search(datasets="mix").collect()
    assert r.variant == "mixed" and r.file_path.endswith(".pdf") and r.path.endswith(".jpg") and r.hash != r.file_hash


def test_collections(spark, lake, tmp_path):
    df = spark.range(3)
    assert [lake.import_collection(df, "c"), lake.import_collection(df.limit(1), "c")] == ["v1", "v2"]
    assert lake.collections.load("c").count() == 1 and lake.collections.load("c", "v1").count() == 3
    with pytest.raises(ValueError):
        lake.import_collection(df, "c", "v1")
    assert lake.collections.list()[0]["num_versions"] == 2 and lake.collections.info("c", "v1")["num_samples"] == 3
    lake.collections.export("c", str(tmp_path / "e"), "v1")
    lake.collections.delete("c", "v1")
    lake.collections.delete("c", "v2")
    assert lake.collections.list() == []
    with pytest.raises(FileNotFoundError):
        lake.collections.load("c")


def test_union_by_name_widens(spark, tmp_path):
    base = "provider=p/dataset={}/task=t/variant=v"
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(str(tmp_path / base.format("2024")))
    spark.createDataFrame([(1.5,)], "x double").write.parquet(str(tmp_path / base.format("d2")))
    spark.createDataFrame([(7, 1)], "y int, z int").write.parquet(str(tmp_path / base.format("d3")))
    df = readers.scan_catalog(spark, str(tmp_path), filename=True)
    types = dict(df.dtypes)
    assert (types["x"], types["y"], types["dataset"]) == ("double", "string", "string") and df.where("dataset = '2024'").count() == 1
    assert "PartitionFilters: [isnotnull(dataset" in df.where("dataset = '2024'")._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        readers.scan_catalog(spark, str(tmp_path / "none"))


def test_readers(spark, tmp_path):
    (tmp_path / "kv.tsv").write_text("a=1 b=x=y a=2\n\n plain c=\n")
    rows = [r.fields for r in readers.read_key_values(spark, str(tmp_path / "kv.tsv")).collect()]
    assert rows == [{"a": ["1", "2"], "b": ["x=y"]}, {"c": [""]}]
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1}], "annotations": [{"image_id": 1}, {"image_id": 1}], "categories": []}))
    assert [d.count() for d in readers.read_coco(spark, str(tmp_path / "c.json"))[:2]] == [1, 2]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).first().b == "x"
    spark.range(2).write.parquet(str(tmp_path / "s"))
    assert readers.read_splits(spark, {"train": str(tmp_path / "s"), "val": str(tmp_path / "no*")}).first().split == "train"
    for bad, error in ((str(tmp_path / "gone"), FileNotFoundError), (str(tmp_path / "c.csv"), ValueError), (5, TypeError)):
        with pytest.raises(error):
            readers.load_source(spark, bad)


def test_schema_jobs_and_selection(tmp_path):
    s = SchemaRegistry(str(tmp_path / "s.yaml"))
    assert s.validate("ocr", META)[0] and not s.validate("none", META)[0] and not s.validate("ocr", None)[0]
    assert s.validate("ocr", {"lang": "ko", "x": 1})[1].startswith("field not allowed") and s.validate("ocr", {"lang": "ko"})[1].startswith("field missing")
    assert s.add_task("new", ["a"]) and not s.add_task("new") and SchemaRegistry(str(tmp_path / "s.yaml")).validate("new", {"a": 1})[0]
    jobs = JobRegistry()
    bad = jobs.start("x", lambda: 1 / 0, background=False)
    assert jobs.get(bad)["status"] == "failed"
    jobs.delete(bad)
    with pytest.raises(KeyError):
        jobs.delete(bad)
    names = ["a-b", "c", "1-2"]
    assert cli.parse_selection("1,2", names) == ["a-b", "c"] and cli.parse_selection("1-3", names) == names
    assert cli.parse_selection("1-2", names) == ["1-2"] and cli.parse_selection("9", names) == [] and cli.parse_selection("a-b", names) == ["a-b"]


def test_cli(spark, lake, tmp_path):
    spark.createDataFrame([("x",)], "label string").write.parquet(str(tmp_path / "src"))
    call = lambda *a: cli.run(cli.parser().parse_args(["--root", str(lake.root), *a]), spark)
    assert call("upload", str(tmp_path / "src"), "test", "d")
    assert call("process", "start")["result"]["success"] == 1 and call("db", "info")["total_rows"] == 1
    assert call("download", "col", "--as-collection") == "v1" and call("collections", "list")[0]["name"] == "col"
    assert call("config", "provider", "create", "zz") and "zz" in call("config", "list")["providers"]


def test_exporters(spark, tmp_path):
    tree = '{"a":{"<|value|>":"v","<|bbox|>":[0.1,0.2,0.5,0.6]},"b":null}'
    df = spark.createDataFrame([("p.jpg", 280, 280, tree)], "path string, width int, height int, label string")
    (r,) = exporters.kie(df).collect()
    assert json.loads(r.messages[1].content) == {"a": {"<|value|>": "v", "<|bbox|>": [28, 56, 140, 168]}} and r.messages[0].content.startswith("<image>Extract")
    assert json.loads(r.messages[0].content.split("\n")[1]) == {"a": {"<|value|>": "", "<|bbox|>": []}}
    assert json.loads(exporters.kie(df, bbox=False).first().messages[1].content) == {"a": {"<|value|>": "v"}}
    lay = '{"reading_order":true,"elements":[{"idx":2,"type":"title","value":"T","bbox":[0,0,1,1]},{"idx":1,"type":"chart","value":"","bbox":[0,0,0.5,0.5]}]}'
    df = df.withColumn("label", F.lit(lay))
    got = exporters.layout(df).first()
    assert [e["type"] for e in json.loads(got.messages[1].content)] == ["image", "plain_text"] and "must be preserved" in got.messages[0].content
    assert exporters.element_crops(df).collect()[0].images == ["p_0.jpg"]
    v = spark.createDataFrame([("p", 2, "q2", "a2"), ("p", 1, "q1", "a1")], "path string, o int, query string, label string")
    assert [m.content for m in exporters.vqa(v, "o").first().messages] == ["<image>q1", "a1", "q2", "a2"]
    t = spark.createDataFrame([("p", "x<otsl>1</otsl>"), ("p", "a\\b"), ("p", None)], "path string, label string")
    assert [r.messages[1].content for r in exporters.otsl(t).collect()] == ["<otsl>1</otsl>"]
    assert exporters.recognition(t.na.fill("zz"), "z").count() == 1
    sinks.write_chat_jsonl(exporters.vqa(v, "o"), str(tmp_path / "chat"))
    assert json.loads(spark.read.text(str(tmp_path / "chat")).first().value)["images"] == ["p"]


def test_streaming(spark, lake, tmp_path):
    lake.upload_raw(spark.createDataFrame([("x",)], "label string"), "test", "d")
    assert drain_staging(spark, lake.ingest, str(tmp_path / "ck"))["success"] == 1
    assert drain_staging(spark, lake.ingest, str(tmp_path / "ck"))["success"] == 0
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    run_available(windowed_counts(stream, late="0 seconds"), str(tmp_path / "agg"), str(tmp_path / "ck2"))
    got = spark.read.parquet(str(tmp_path / "agg"))
    want = windowed_counts(events)
    assert 0 < got.count() <= want.count() and got.select("start", "event_type", "n").exceptAll(want.select("start", "event_type", "n")).count() == 0
