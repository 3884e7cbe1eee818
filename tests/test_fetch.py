import threading
import time

import pytest

from loomlake.sources import fetch


def test_chunks(spark):
    df = spark.range(50_000).selectExpr("id", "id % 7 as k", "repeat('x', 100) as pad").repartition(5)
    with fetch.Chunks(df, ["k", "id"], 7_000) as chunks:
        got, sizes = [], []
        for c in chunks:
            sizes.append(len(c))
            got += list(zip(c["k"], c["id"]))
        assert sizes == [7_000] * 7 + [1_000] and len(chunks) == 8
        assert got == sorted((i % 7, i) for i in range(50_000))
        again = fetch.concat_chunks([chunks.chunk(k) for k in range(len(chunks))])
        assert again.select("id").distinct().count() == 50_000 == again.count()
        plan = chunks.chunk(3)._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(_n,21000)" in plan  # the range reaches the reader
    with fetch.Chunks(df, "k", 20_000, start=1) as some:  # ties: each row in one chunk
        assert sum(len(c) for c in some) == 30_000
    with fetch.Chunks(df.limit(0), "k", 5) as none:
        assert list(none) == [] and len(none) == 0
    with pytest.raises(ValueError):
        fetch.Chunks(df, "k", 0)


def test_new_partitions(spark, tmp_path):
    def put(dataset, n, provider="p"):
        at = tmp_path / f"provider={provider}/dataset={dataset}/task=t/variant=v"
        spark.range(n).selectExpr("id", "cast(id as string) as s").write.mode("append").parquet(str(at))

    put("a", 3)
    table = fetch.register(spark, str(tmp_path), "found_here")
    assert table.count() == 3 and fetch.partitions(spark, "found_here") == {"provider=p/dataset=a/task=t/variant=v"}
    put("b", 4)
    assert spark.table("found_here").count() == 3
    assert fetch.discover(spark, "found_here") == {"provider=p/dataset=b/task=t/variant=v"}
    assert spark.table("found_here").where("dataset = 'b'").count() == 4 and fetch.discover(spark, "found_here") == set()
    want = {"provider=p/dataset=c/task=t/variant=v"}
    t = time.time()
    with pytest.raises(TimeoutError):
        fetch.discover(spark, "found_here", want, timeout=1, poll=0.3)
    assert time.time() - t < 10
    later = threading.Timer(1.0, lambda: put("c", 1))
    later.start()
    assert fetch.discover(spark, "found_here", want, timeout=60, poll=0.5) == want
    later.join()
    spark.sql("DROP TABLE found_here")
    assert (tmp_path / "provider=p").exists()
