import random
import re

from loomlake.llm import ngram_join as J


def brute(rows):
    sets = {}
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=70)
    base = [r.choices(words, k=r.choice([3, 5, 6, 9, 40, 150])) for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.6 else r.choices(words, k=r.choice([1, 4, 5, 8, 60]))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.4:
            w = passage + w
        rows.append((i, r.choice([" ", "\n", "  "]).join(w) if r.random() < 0.9 else " ".join(w).upper()))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "wort é ü"), (n + 4, "WORT é ü")]


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id").selectExpr("id as doc_id", "text", "1 as n", "2 as rep")
    return sorted(map(tuple, J.join_components(df, **k).collect()))


def test_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_frequent_tokens_only(spark, monkeypatch):
    """All tokens frequent: links come from combinations alone."""
    import numpy as np

    monkeypatch.setattr(J, "frequent_cells", lambda c: np.full((1 << J.CELL_BITS) // 8, 255, np.uint8))
    rows = corpus(2, 120)
    assert run(spark, rows, rounds=1) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Keys of more than two vertices in blocks of eight."""
    blocks = J.likely_in_blocks
    monkeypatch.setattr(J, "FEW", 2)
    monkeypatch.setattr(J, "likely_in_blocks", lambda *a: blocks(*a, size=8))
    rows = corpus(5, 120)
    assert run(spark, rows, rounds=1) == brute(rows)


def test_combinations_meet():
    import numpy as np

    r = np.random.default_rng(3)
    for n in [*range(1, 60), 150, 700]:
        for _ in range(5):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            d = n // 9
            b = np.unique(np.concatenate([a[d:], r.integers(0, 2**63, d, dtype=np.uint64)]))
            o = len(np.intersect1d(a, b))
            if 100 * o >= 80 * (len(a) + len(b) - o):
                assert len(np.intersect1d(J.combination_keys(a), J.combination_keys(b)))


def test_edge_tables(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "A B C")], "doc_id long, text string")
    got = sorted(map(tuple, J.join_components(df).collect()), key=str)
    assert got == sorted([(None, 1, None), (4, 1, 4), (4, 1, 4), (9, 1, 4)], key=str)
    assert sorted(r.doc_id or 0 for r in J.first_of_each(df).collect()) == [0, 4, 4]


def test_all_sets_are_counted_and_linked_beyond_those_noted(spark, monkeypatch):
    """A task notes a few sets only: the others are still counted, and links are the same."""
    monkeypatch.setattr(J, "NOTED", 5)
    words = lambda i: " ".join(f"w{i // 2}x{j}" for j in range(60))
    rows = [(i, words(i) + (" end" if i % 2 else "")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    total = J.sketch(df).where("total is not null").selectExpr("sum(total)").first()[0]
    assert total == sum(len(J.shingle_sets([t.encode()])[0]) for _, t in rows)
    got = {r.doc_id: r.component_id for r in J.join_components(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}
