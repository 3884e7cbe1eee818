import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomlake.operators import windows as W
from loomlake.operators.search import present_columns
from loomlake.sources.footers import Catalog
from loomlake.sources.readers import PARTITION_KEYS

LEAF = "provider={}/dataset=d%3A{}/task=t/variant=v+w"


def put(root, provider, k, **columns):
    at = root / LEAF.format(provider, k)
    at.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), at / f"data{k}.parquet")
    return at / f"data{k}.parquet"


def test_types_and_nulls(spark, tmp_path):
    put(tmp_path, "a", 0, i=pa.array([1, None], pa.int32()), s=["x", None], e=pa.nulls(2, pa.string()))
    put(tmp_path, "a", 1, i=pa.array([5], pa.int64()), x=pa.array([1.5], pa.float32()), l=[[]])
    put(tmp_path, "b", 2, i=pa.array([7], pa.int32()), s=pa.nulls(1, pa.string()), l=pa.array([None], pa.list_(pa.int32())), st=[{"a": None, "b": 1}])
    c = Catalog(spark, str(tmp_path), PARTITION_KEYS)
    assert dict(c.frame.dtypes) | {"i": "bigint", "x": "float"} == dict(c.frame.dtypes)
    assert sorted(c.frame.select("i").toPandas()["i"].dropna()) == [1, 5, 7]
    for keys in ({}, {"provider": "a"}, {"provider": "b"}, {"provider": ["a", "b"]}, {"dataset": "d:1"}, {"variant": "v+w"}, {"provider": "none"}):
        df = c.frame
        for k, v in keys.items():
            df = df.where(F.col(k).isin(v))
        assert c.present(**keys) == present_columns(df), keys
        assert sorted(map(repr, c.search(**keys).collect())) == sorted(map(repr, df.select(*present_columns(df)).collect()))
    with pytest.raises(FileNotFoundError):
        Catalog(spark, str(tmp_path / "gone"), PARTITION_KEYS)


def test_types_that_no_reader_widens(spark, tmp_path):
    put(tmp_path, "a", 0, v=pa.array([1], pa.int64()), w=["a"])
    put(tmp_path, "a", 1, v=["x"], w=["b"])
    put(tmp_path, "b", 2, w=["c"])
    put(tmp_path, "b", 3, v=pa.array([2.5]))
    df = Catalog(spark, str(tmp_path), PARTITION_KEYS, filename=True).frame
    assert sorted(map(str, (r.v for r in df.collect()))) == ["1", "2.5", "None", "x"] and df.where("w is not null").count() == 3
    assert df.select("filename").distinct().count() == 4


def test_no_page_is_read(spark, tmp_path):
    """The pages are overwritten; the footers alone tell which columns have values."""
    path = put(tmp_path, "a", 0, i=list(range(1000)), e=pa.nulls(1000, pa.string()))
    data = bytearray(path.read_bytes())
    footer = int.from_bytes(data[-8:-4], "little")
    data[4 : len(data) - 8 - footer] = bytes(len(data) - 12 - footer)
    path.write_bytes(bytes(data))
    c = Catalog(spark, str(tmp_path), PARTITION_KEYS)
    assert c.present(provider="a") == ["i", *PARTITION_KEYS]
    with pytest.raises(Exception):
        c.frame.select("i").collect()


def test_many_files(spark, tmp_path):
    src = [put(tmp_path, f"p{k % 4}", k, **({"a": [k], f"c{k % 2}": [str(k)]} if k % 3 else {"a": pa.array([k], pa.int32())})) for k in range(40)]
    for k in range(40, 10_000):
        at = src[k % 40]
        (at.parent / f"more{k}.parquet").write_bytes(at.read_bytes())
    t = time.time()
    c = Catalog(spark, str(tmp_path), PARTITION_KEYS)
    assert c.present(provider="p1") and time.time() - t < 60
    assert c.frame.where("provider = 'p1'").count() == 2500


@pytest.mark.parametrize("before", [0, 7])
def test_numbers_with_all_columns(spark, before):
    """All columns kept, a repartition before, a group of most rows, null groups and repeated orders."""
    df = spark.range(30_000).selectExpr("if(id % 5 = 0, cast(id % 40 as string), if(id % 7 = 0, null, 'hot')) as g", "id", "id div 3 as o", "repeat('x', cast(id % 50 as int)) as pad", "rand(1) as r")
    df = df.repartition(before) if before else df
    got = W.numbered(df, "g", ["o", "id"], "n")
    rows = got.collect()
    assert got.columns == [*df.columns, "n"]
    want = {}
    for r in sorted(rows, key=lambda r: (r.o, r.id)):
        assert r.n == want.get(r.g, 0), r
        want[r.g] = want.get(r.g, 0) + 1
    assert [r.n for r in sorted(got.select("id", "n").collect())] == [r.n for r in sorted(rows, key=lambda r: r.id)]
    assert got.select("g", "n").distinct().count() == 30_000
