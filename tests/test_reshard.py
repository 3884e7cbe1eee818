import hashlib

from loomlake.plans.reshard import planned, reshard


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def make(root, n):
    base, rows = "provider=p/dataset=d#1", []
    for i in range(n):
        h = hashlib.sha256(f"{i}".encode()).hexdigest()
        (root / base).mkdir(parents=True, exist_ok=True)
        (root / base / f"{h}.jpg").write_bytes(f"{i}".encode())
        rows += [(f"{base}/{h}.jpg", i)] * (1 + i % 3)
    return rows, {f"{base}/{h[:2]}/{h}.jpg": f"{i}".encode() for i in range(n) for h in [hashlib.sha256(f"{i}".encode()).hexdigest()]}


def test_moves_and_runs_again(spark, tmp_path):
    rows, want = make(tmp_path, 120)
    gone = f"provider=p/dataset=d#1/{'f' * 64}.jpg"
    schema = "path string, i int"
    # half of it, as a run that was killed leaves it
    reshard(spark, spark.createDataFrame(rows[:100], schema), str(tmp_path), levels=1)
    half = tree(tmp_path)
    assert half != want and set(half.values()) == set(want.values())
    df = spark.createDataFrame([*rows, (gone, -1), (None, -2)], schema)
    for again in (False, True):
        got = reshard(spark, df, str(tmp_path), levels=1).collect()
        assert tree(tmp_path) == want
        assert sorted(r.path for r in got) == sorted(want) and {r.outcome for r in got} == ({"there"} if again else {"moved", "there"})
    # rows that already have the new path
    new = spark.createDataFrame([(p, 0) for p in want], schema)
    assert reshard(spark, new, f"file://{tmp_path}", levels=1).count() == len(want) and tree(tmp_path) == want


def test_equi_joins(spark, tmp_path):
    rows, _ = make(tmp_path, 3)
    plan = planned(spark, spark.createDataFrame(rows, "path string, i int"), str(tmp_path))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
