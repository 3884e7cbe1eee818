"""Functions over broken and unbounded inputs, and steps on files."""

import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlake.functions import jsontree as J
from loomlake.functions import tables as H
from loomlake.operators import joins, sampling, windows
from loomlake.sources import readers, sinks

DEEP_HTML = "<div>" * 3000 + "<table><tr><td>" * 1200 + "x"
DEEP_JSON = "[" * 5000 + "]" * 5000


def test_deep_pages_and_labels(spark):
    df = spark.createDataFrame([(1, DEEP_HTML, DEEP_JSON), (2, "<table><tr><td>a</td></tr></table>", '{"a":null}'), (3, None, None)], "id int, html string, label string")
    got = {r.id: r for r in df.select("id", H.tables_of("html").alias("t"), H.otsl_of("html").alias("o"), J.json_remove_none("label").alias("j"), F.size(J.json_key_boxes("label")).alias("k")).collect()}
    assert len(got[1].t) == 1200 and got[1].t[0] == "<table><tr><td>x</td></tr></table>" and got[1].o.startswith("<otsl><fcel>x")
    assert (got[1].j, got[2].j, got[3].j) == (DEEP_JSON, "{}", None) and got[1].k == 0
    assert got[2].t == ["<table><tr><td>a</td></tr></table>"] and got[3].t == [] and got[3].o is None


def test_spans_have_bounds():
    assert H.to_otsl('<table><tr><td colspan="1000000000">a</td></tr></table>') == "<otsl><fcel>a" + "<lcel>" * 999 + "<nl></otsl>"
    assert H.to_otsl('<table><tr><td colspan="\u00b2" rowspan="-3">a</td><td rowspan="999999999">b</td></tr><tr><td>c</td></tr></table>') == "<otsl><fcel>a<fcel>b<nl><fcel>c<ucel><nl></otsl>"
    assert H.to_otsl("<table><tr><td><table><tr><td>i</td></tr></table></td></tr></table>") == "<otsl><fcel>i<nl></otsl>"
    assert H.to_otsl("<p>none</p>") is None


def test_tables_from_the_inside_out():
    html = '<table id="o"><caption>c</caption><tr><td><table id="m"><tr><td colspan="1"><table id="i"></table></td></tr></table></td></tr></table><table id="z"></table>'
    assert H.extract_tables(html) == ['<table id="i"></table>', '<table id="z"></table>', '<table id="m"><tr><td></td></tr></table>', '<table id="o"><tr><td></td></tr></table>']


def test_weave_by_definition(spark):
    def brute(tokens, cells):
        texts = [t for t in ("".join(x for x in c if x not in ("<b>", "</b>", "<i>", "</i>")) for c in cells) if t]
        out = ""
        for t in tokens:
            if not texts:
                break
            out += f"<{t}>" + (texts.pop(0) if t == "fcel" else "")
        return ("" if "<otsl>" in out else "<otsl>") + out + ("" if "</otsl>" in out else "</otsl>")

    rows = [(["fcel", "ecel", "fcel", "nl", "fcel"], [["<b>", "a", "</b>"], ["<i>", "</i>"], ["b"]]), (["otsl", "fcel", "nl", "/otsl"], [["a"], ["b"]]), (["ecel", "nl"], [["a"]]), (["fcel"], []), ([], [["a"]]), (["ecel", "fcel", "nl"], [["x"], ["y"]])]
    df = spark.createDataFrame(rows, "tokens array<string>, cells array<array<string>>")
    assert [r[0] for r in df.select(J.weave_otsl(F.col("tokens"), F.col("cells"))).collect()] == [brute(*x) for x in rows]


def test_column_centres_are_ranked(spark):
    from loomlake.operators.aggregates import column_centres

    df = spark.createDataFrame([(1, float(x)) for x in (0, 1, 2, 50, 51, 99, 100)] + [(2, 7.0)], "page int, x double")
    got = sorted((r.page, r.x, r.column) for r in column_centres(df, "page", "x").collect())
    assert got == [(1, 0.0, 0), (1, 1.0, 0), (1, 2.0, 0), (1, 50.0, 1), (1, 51.0, 1), (1, 99.0, 2), (1, 100.0, 2), (2, 7.0, 0)]


def test_samples_of_any_size(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    want = [r.k for r in df.orderBy(sampling.draw("k"), "k").collect()]
    for n in (-1, 0, 1, 7, 1500, 3000, 4000):
        assert {r.k for r in sampling.sample_n(df, n, "k").collect()} == set(want[: max(n, 0)])
    assert [r.k for r in sampling.shuffled(df, "k").collect()] == want


def test_numbers_of_a_hot_group(spark):
    df = spark.range(2000).selectExpr("if(id % 10 = 0, concat('g', id), 'hot') as g", "id")
    got = [r.n for r in windows.numbered(df, "g", "id", "n").where("g = 'hot'").orderBy("id").collect()]
    assert got == list(range(1800))
    rows = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (None, 2, "c"), (None, 3, "d")], "k int, o int, v string")
    assert sorted(r.v for r in joins.last_by(rows, ["k"], "o").collect()) == ["b", "d"]
    assert sorted(r.v for r in windows.first_of(rows, ["k"], "o").collect()) == ["a", "c"]


def test_arrow_folders(spark, tmp_path):
    for i in range(3):
        t = pa.table({"a": [i, i + 1], "b": ["x", None]})
        with pa.OSFile(str(tmp_path / f"data-{i}.arrow"), "wb") as f, (pa.ipc.new_file if i else pa.ipc.new_stream)(f, t.schema) as w:
            w.write_table(t)
    assert sorted(map(tuple, readers.read_arrow(spark, str(tmp_path)).collect()), key=str) == sorted([(i + j, "x" if not j else None) for i in range(3) for j in range(2)], key=str)
    assert readers.read_arrow(spark, str(tmp_path / "data-1.arrow")).count() == 2


def test_archives_and_report(spark, tmp_path):
    for name, member in (("keep_one", "d/x.txt"), ("other", "y.txt"), ("keep_bad", "../z.txt")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(member, "t")
    out = tmp_path / "out"
    assert readers.extract_zips(str(tmp_path), str(out), "keep_one") == [str((out / "keep_one").resolve())]
    assert (out / "keep_one/d/x.txt").read_text() == "t" and not (out / "other").exists()
    with pytest.raises(ValueError):
        readers.extract_zips(str(tmp_path), str(out), "bad")
    path = str(tmp_path / "report.json")
    sinks.write_report(spark, path, {"total_items": 4, "missing_count": 1}, ["p"], "2024-01-01T00:00:00")
    assert json.load(open(path)) == {"timestamp": "2024-01-01T00:00:00", "summary": {"total_items": 4, "checked_items": 0, "missing_count": 1, "integrity_rate": 0}, "missing_files": ["p"]}
