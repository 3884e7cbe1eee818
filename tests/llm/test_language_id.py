import math
import random
from collections import Counter, defaultdict

from loomlake.llm import language_id as L


def brute_bits(counts, lang, text, order=3):
    """PPM by its definition."""
    tree = defaultdict(Counter)
    for name, gram, n in counts:
        if name == lang:
            size = gram >> 32
            b = (gram & 0xFFFFFFFF).to_bytes(4, "big")[4 - size :]
            tree[b[:-1]][b[-1]] += n
    bits = 0.0
    for i, s in enumerate(text):
        for k in range(min(order, i), -1, -1):
            c = tree.get(text[i - k : i])
            if not c:
                continue
            total, q = sum(c.values()), len(c)
            if s in c:
                bits -= math.log2(c[s] / (total + q))
                break
            bits -= math.log2(q / (total + q))
        else:
            bits += 8
    return bits


def table(spark, n=200):
    r = random.Random(5)
    syllables = {"aa": ["tion", "ing", "the", "er"], "bb": ["eux", "é", "oi", "le"], "cc": ["ung", "sch", "ü", "ein"]}
    rows = []
    for i in range(n):
        lang = r.choice(sorted(syllables))
        rows.append((i, " ".join("".join(r.choices(syllables[lang], k=3)) for _ in range(r.randrange(3, 60))), lang, "x"))
    return spark.createDataFrame([*rows, (900, None, "aa", "x"), (901, "123 !", "bb", "x"), (902, "", None, "x"), (None, "the ing", "aa", "x"), (903, "thetioning " * 20000, None, "x")], "doc_id long, text string, lang string, score string")


def test_exact_code_lengths(spark):
    df = table(spark).where("lang is not null and text is not null").limit(40)
    counts = [tuple(r) for r in L.count_contexts(df.select("lang", "text"), 3).collect()]
    m = L.Model(counts)
    texts = ["tioning éeux".encode(), b"", b"q", "schü the".encode(), b"\x00\xffzz"]
    got = m.bits(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(m.langs):
            assert abs(got[i, j] - brute_bits(counts, lang, t)) < 1e-3 * max(1, len(t))


def test_code_lengths_of_what_fit_makes(spark):
    """fit() keeps all sequences of its sample; long texts are scored in blocks to the same length."""
    df = table(spark, 60).where("doc_id < 900 and lang is not null and text is not null")
    used = df.where(~L.held_out())
    counts = [tuple(r) for r in L.count_contexts(used.select("lang", "text"), 3).collect()]
    assert min(n for *_, n in counts) == 1
    m, block = L.fit(df), L.BLOCK
    texts = ["the ingtion schü".encode(), b"zz\xff", "oi\u00e9 the ".encode() * 30]
    want = [[brute_bits(counts, lang, t) for lang in m.langs] for t in texts]
    try:
        for L.BLOCK in (block, 7):
            got = m.bits(texts)
            assert all(abs(g - w) < 1e-3 * len(t) for t, gs, ws in zip(texts, got, want) for g, w in zip(gs, ws))
    finally:
        L.BLOCK = block
    small = L.fit(df, max_nodes=200)
    assert all(sum(len(x.codes) for x in t.sets) <= 200 for t in small.trees) and L.predict(df, small).count() == df.count()


def test_held_out_accuracy_and_edges(spark):
    df = table(spark)
    model = L.fit(df)
    rows = {r.doc_id: r for r in L.predict(df, model).collect()}
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [i for i, r in rows.items() if r.held_out and i is not None and i < 900]
    assert len(held) > 20 and all(rows[i].lang_pred == truth[i] for i in held)
    assert [rows[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = L.label(df, model)
    assert kept.columns == df.columns and kept.count() == 202
    assert L.predict(df.limit(0), L.fit(df.limit(0))).count() == 0
    assert {r.lang_pred for r in L.predict(df, L.fit(df.limit(0))).collect()} == {"und"}
