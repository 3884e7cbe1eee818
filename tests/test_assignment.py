import random
import time

import numpy as np

from loomlake.operators.aggregates import column_centres
from loomlake.operators.joins import _Free, assign_by_cer


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(refs, texts):
    free, out = list(range(len(texts))), []
    for r in refs:
        k = min(free, key=lambda i: (distance(r, texts[i]) / len(texts[i]) if texts[i] else float("inf"), i))
        free.remove(k)
        out.append(k)
    return out


def test_greedy_against_all_pairs():
    r = random.Random(0)
    for k in range(150):
        word = lambda: "".join(r.choices("abc" if k % 2 else "abcdefé😀", k=r.randrange(0, 9)))  # noqa: E731, B023
        n = r.randrange(1, 25)
        texts = [word() for _ in range(n)]
        refs = [r.choice([word(), r.choice(texts)]) for _ in range(n)]
        free = _Free(texts, block=r.choice([1, 3, 128]))
        assert [free.take(x) for x in refs] == plain(refs, texts), (refs, texts)


def test_columns(spark):
    rows = [(1, i, "abc"[i % 3]) for i in range(6)] + [(2, 0, "x"), (None, 1, "y")]
    texts = [(1, 10 + i, "cba"[i % 3]) for i in range(6)] + [(2, 0, "x"), (2, 1, "z"), (None, 5, "yy")]
    got = assign_by_cer(spark.createDataFrame(rows, "g int, pos int, ref string"), spark.createDataFrame(texts, "g int, idx int, text string"), "g")
    assert sorted(map(repr, got.select("g", "pos", "text").collect())) == sorted(f"Row(g={g}, pos={p}, text={t!r})" for g, p, t in [(1, i, "abc"[i % 3]) for i in range(6)] + [(2, 0, ""), (None, 1, "yy")])


def test_one_large_group(spark):
    """100,000 references in one group: most have their text, every twentieth one with a letter changed."""
    n = 100_000
    refs = spark.range(n).selectExpr("0 as g", "id as pos", "concat('item-', lpad(cast((id * 7919) % 100000 as string), 6, '0'), '-', hex(id * 2654435761 % 4294967296)) as ref")
    texts = refs.selectExpr("g", "pos * 31 % 100000 as idx", "if(pos % 20 = 0, concat(substr(ref, 1, 12), '#', substr(ref, 14)), ref) as text")
    t = time.time()
    got = assign_by_cer(refs, texts, "g")
    bad = "text <> if(pos % 20 = 0, concat(substr(ref, 1, 12), '#', substr(ref, 14)), ref)"
    assert got.selectExpr("count(*)", f"count_if({bad})").first() == (n, 0) and time.time() - t < 200


def lloyd(x, k, least):
    x = np.array(x, float)
    c = np.unique(np.linspace(x.min(), x.max(), k))
    at = None
    while True:
        new = np.abs(x[:, None] - c).argmin(1)
        if at is not None and (new == at).all():
            break
        at = new
        c = np.array([x[at == i].mean() if (at == i).any() else c[i] for i in range(len(c))])
    rank = {a: i for i, a in enumerate(np.unique(at))}
    col = [rank[a] for a in at]
    size = {j: col.count(j) for j in set(col)}
    main = lambda i: max(sorted(size), key=lambda j: (size[j], -abs(j - i)))
    return [main(i) if size[i] < least else i for i in col]


def test_columns_of_pages(spark):
    r = random.Random(1)
    rows, want = [], {}
    for page in range(40):
        x = [r.choice([10, 200, 390]) + r.randrange(-40, 41) * (page % 3) for _ in range(r.randrange(1, 30))]
        x += [900] * (page % 2)
        want |= {(page, i): c for i, c in enumerate(lloyd(x, 3, 2))}
        rows += [(page, i, v) for i, v in enumerate(x)]
    rows.append((99, 0, None))
    df = spark.createDataFrame(rows, "page int, i int, x int")
    got = {(p.page, p.i): p.column for p in column_centres(df, "page", "x", least=2).collect()}
    assert got.pop((99, 0)) is None and got == want
    hot = spark.range(300_000).selectExpr("1 as page", "id % 3 * 100 + id % 7 as x")
    assert column_centres(hot, "page", "x").where("column <> x div 100").count() == 0


def test_columns_of_many_small_pages(spark):
    """Pages are clustered together, not one call for each: 120,000 of them, every 2,000th held against plain k-means."""
    df = spark.range(480_000).selectExpr("id div 4 as page", "id % 4 as i", "cast(pmod(xxhash64(id), 1000) as int) as x")
    t = time.time()
    out = column_centres(df, "page", "x", least=2)
    assert out.where("column is not null").count() == 480_000 and time.time() - t < 60
    some = out.where("page % 2000 = 7").orderBy("page", "i").collect()
    for k in range(0, len(some), 4):
        assert [p.column for p in some[k : k + 4]] == lloyd([p.x for p in some[k : k + 4]], 3, 2)


def test_copies_that_differ_from_all_texts():
    """40,000 references of few kinds, none equal to a text: each kind is sought once, not each of its copies."""
    names = [f"{a}{b}{c}" for a in ("large", "small", "hot", "old") for b in (" ring ", " bolt ", " plate ") for c in ("one", "two", "three")]
    texts = [names[i % len(names)] for i in range(40_000)]
    t, free = time.time(), _Free(texts)
    got = [free.take(x[1:]) for x in texts]
    assert sorted(got) == list(range(40_000)) and time.time() - t < 10
    few = texts[:300]
    free = _Free(few)
    assert [free.take(x[1:]) for x in few] == plain([x[1:] for x in few], few)
