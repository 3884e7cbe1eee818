import random
import re
from collections import Counter

import duckdb
import pytest

from loomlake.llm import collocations as C

SF = "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most):
    f: dict[str, Counter] = {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            c = f.setdefault("und" if lang is None else lang, Counter())
            c.update(w[i : i + k] for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for s, v in c.items() if len(s) == 1)
        found = []
        for s, a in c.items():
            if len(s) == 1 or a < least:
                continue
            if any(100 * v >= 80 * a for t, v in c.items() if v >= least and len(t) > len(s) and any(t[i : i + len(s)] == s for i in range(len(t)))):
                continue
            score, k = min((2_000_000 * a // (c[s[:k]] + c[s[k:]]), k) for k in range(1, len(s)))
            found.append((-score, -a, " ".join(s).encode(), c[s[:k]], c[s[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(n=400, seed=0):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "c", "New", "york", "é", "\xa0", "x\x00y", "日本", "s", "😀", "ﬀ"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ""]) for _ in range(r.randrange(60)))
    return [(None if r.random() < 0.05 else text() + " New York City hall. " * r.randrange(3), r.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("block_words,most", [(4_000_000, 2000), (50, 7), (1, 2000)])
def test_against_plain_counts(spark, block_words, most):
    rows = corpus() + [("a b " * 5000 + ". c", "fr"), ("", "it"), (" ", "it")]
    df = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "text string, lang string, words int").repartition(7)
    got = sorted(map(tuple, C.best(df, most=most, least=10, block_words=block_words, parts=3).collect()))
    assert got == plain(rows, 10, most) and got


def test_common_word_and_copies(spark):
    """One text makes most rows, and one language."""
    rows = [("New York. It is it is.", "en")] * 500 + corpus(60, 1)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(9)
    assert sorted(map(tuple, C.best(df).collect())) == plain(rows, 30, 2000)


def test_parts_of_a_long_text():
    text = ("a b. " * 2000 + "c " * 5000 + ". d").encode()
    for some in (7, 100, 1 << 20):
        parts = list(C.pieces(text, some))
        assert [w for p in parts for w in p if w] == text.replace(b".", b" \xff ").split()
        assert all(p[-2:] == [C._BREAK, b""] for p in parts[:-1])


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.best(df).count() == 0
    assert C.best(spark.createDataFrame([(None, None), ("", "en")], df.schema)).count() == 0


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    res = con.execute(C.oracle_sql())
    names = [d[0] for d in res.description]
    got = C.best(spark.read.parquet(f"{SF}/documents.parquet")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(res.fetchall())
