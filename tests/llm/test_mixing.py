import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.llm import mixing as M


def corpus(spark, n=3000):
    r = random.Random(1)
    rows = []
    for i in range(n):
        src = "s0" if r.random() < 0.4 else f"s{r.randrange(1, 6)}"
        rows.append((i, "word " * r.randrange(0, 80) + r.choice(["", " | ", "###", "123"]), r.choice(["en", "en", "de", None]), src, 0))
    return spark.createDataFrame([*rows, (9000, None, "en", "s1", 0), (None, "a b", None, None, 0)], "doc_id long, text string, lang string, source string, weight int")


def shares(rows, name, column):
    out = defaultdict(float)
    for r in rows:
        out[r[name]] += r.n_tokens * column(r)
    total = sum(out.values())
    return {k: x / total for k, x in out.items()}


def test_drawn_margins_are_near_their_targets(spark):
    """By probability, not by weight alone: within ``allowed`` of the targets, and the draw within chance of it."""
    df = corpus(spark)
    lang = {"en": 0.5, "de": 0.3, M.NULL: 0.2, "xx": 0.4}
    rows = M.mixture(df, targets={"lang": lang}, allowed=0.01).collect()
    assert len(rows) == 3002 and {r.topic for r in rows} <= {f"t{i}" for i in range(M.TOPICS)}
    (rate,), (off,) = {r.rate for r in rows}, {r.deviation for r in rows}
    assert off <= 0.01 and 0 < rate <= 0.5
    for name, power in (("lang", None), ("source", 0.5), ("topic", 0.5)):
        own = shares(rows, name, lambda r: 1)
        z = sum(x**power for x in own.values()) if power else 1
        for k, x in shares(rows, name, lambda r: r.probability).items():
            want = own[k] ** power / z if power else {"en": 0.5, "de": 0.3, None: 0.2}[k]
            assert abs(x - want) <= off + 1e-9
            assert abs(shares(rows, name, lambda r: r.sampled).get(k, 0) - want) < 0.06
    assert M.sample(df).columns == df.columns


def brute(cells, mass, targets, rate):
    """Factors raked value by value: each solved by bisection with the bound of 1, in plain loops."""
    f = [[1.0] * len(t) for t in targets]

    def p(c):
        return min(1.0, rate * math.prod(f[k][v] for k, v in enumerate(c)))

    for _ in range(300):
        for k, want in enumerate(targets):
            for v, w in enumerate(want):
                low, high = 0.0, 1e9
                for _ in range(100):
                    f[k][v] = (low + high) / 2 if high < 1 or low else math.sqrt(max(low, 1e-9) * high)
                    got = sum(m * p(c) for c, m in zip(cells, mass) if c[k] == v)
                    low, high = (f[k][v], high) if got < w * rate * sum(mass) else (low, f[k][v])
    return [p(c) for c in cells]


def test_raking_by_brute_force():
    r = np.random.default_rng(2)
    cells = np.array([(a, b) for a in range(3) for b in range(3)])
    for rate in (0.2, 0.45):
        mass = r.integers(20, 60, 9).astype(float)
        targets = [np.array([0.3, 0.3, 0.4]), np.array([0.25, 0.4, 0.35])]
        p, off = M.rake(cells, mass, targets, rate, 2000, 1e-12)
        assert off < 1e-9 and np.allclose(p, brute(cells.tolist(), mass.tolist(), [t.tolist() for t in targets], rate), atol=1e-5)


def test_distributed_equals_driver(spark):
    """On a sparse table with many sources."""
    r = random.Random(3)
    rows = [(f"s{r.randrange(60)}", r.choice("abc"), float(r.randrange(1, 90))) for _ in range(150)]
    cells = spark.createDataFrame(rows, "m0 string, m1 string, mass double").groupBy("m0", "m1").agg(F.sum("mass").alias("mass"))
    options = ({}, {"x": 0.5}, 0.4, ("x", "y"))
    one, small = M.calibrate(cells, *options, 1000, 1.0, 12, 1e-6)
    two, large = M.calibrate(cells, *options, 3, 1.0, 12, 1e-6)
    assert small and not large
    one, two = ({(r.m0, r.m1): r for r in x.collect()} for x in (one, two))
    assert one.keys() == two.keys()
    assert all(abs(one[k][c] - two[k][c]) < 1e-9 for k in one for c in ("weight", "probability", "rate", "deviation"))


def test_topics_do_not_depend_on_partitions(spark):
    df = corpus(spark, 300)
    a, b = ({(r.doc_id, r.lang): (r.topic, r.probability) for r in M.mixture(df.repartition(n)).collect()} for n in (1, 7))
    assert a == b
    texts = [b"alpha beta gamma alpha"] * 3 + [b"delta epsilon zeta", b"", b"x " * 500_000]
    n, v = M.term_vectors(texts)
    assert n.tolist() == [4, 4, 4, 3, 0, 500_000] and (v[0] == v[2]).all() and not v[4].any()


def test_edges(spark):
    df = corpus(spark, 1)
    assert M.mixture(df.limit(0)).count() == 0 and M.sample(df.limit(0)).count() == 0
    assert {r.probability for r in M.mixture(df.where("text is null")).collect()} == {0.5}
    with pytest.raises(ValueError):
        M.mixture(df, targets={"lang": {"zz": 1.0}})
    clash = df.withColumnsRenamed({"weight": "_weight"}).selectExpr("*", "1 as _topic", "2 as c0", "3 as m0", "4 as draw", "5 as vector", "6 as n_tokens", "7 as sampled", "8 as probability")
    assert M.sample(clash).columns == clash.columns and M.mixture(clash.union(clash)).count() == 2 * df.count()
