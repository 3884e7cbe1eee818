import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomlake.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts):
    lib = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append([*lib.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, want in ids.items():
        left = [len(w) for w in want]
        assert sum(r.length for r in by_doc[i]) == sum(left)
        for r in by_doc[i]:
            assert any(len(w) == r.doc_tokens and zlib.crc32(np.array(w[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for w in want)
        if len(want) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0


def test_all_ids_once_without_padding(spark):
    texts = [(i, " ".join(f"word{(i * j) % 97} thistle" for j in range(i * 7 % 900))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "long text " * 90000), (203, "copy"), (203, "copy"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, pos int, members int")
    for options in ({}, {"shard_docs": 7, "links": 0}, {"shard_docs": 2, "terms": 3}):
        check(P.pack(df, PATH, **options).collect(), texts)
    assert P.pack(df.limit(0), PATH).count() == 0


def brute_scores(docs, seed, idf, mean):
    """BM25 by its definition."""
    out = []
    for d in docs:
        s = 0.0
        for t in set(docs[seed].tolist()):
            tf = d.tolist().count(t)
            s += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        out.append(s)
    return np.array(out)


def bag(ids):
    return np.stack(np.unique(ids, return_counts=True), 1).astype("<u4")


def test_scores_are_bm25():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 60, r.integers(5, 60)) for _ in range(80)]
    idf = r.random(60)
    index = P.Index([bag(d) for d in docs], [len(d) for d in docs], idf, 30.0)
    for seed in (0, 17, 79):
        assert np.allclose(index.scores(bag(docs[seed])), brute_scores(docs, seed, idf, 30.0))


def test_windows_take_the_best_unused():
    """Packer against greedy filling with brute-force scores over all unused documents; ties go by order."""
    r = np.random.default_rng(6)
    docs = [r.integers(0, 40, r.integers(3, 30)) for _ in range(90)] + [np.array([1, 2, 3])] * 4
    idf, window = np.round(r.random(40), 1), 64
    rows = [(bag(d).tobytes(), np.array([i, len(d)], np.int64).tobytes()) for i, d in enumerate(docs)]
    p = P.Packer(idf, 20.0, window)
    p.shard(rows)
    p.finish()
    unused, seed, room, want = list(range(len(docs))), None, window, []
    while unused:
        if seed is None:
            d = unused[0]
        else:
            score = brute_scores(docs, seed, idf, 20.0)
            d = min(unused, key=lambda i: (-round(score[i], 9), i))
        unused.remove(d)
        want.append(d)
        if len(docs[d]) >= room:
            over = len(docs[d]) - room
            room, seed = window - over, d if over else None
        else:
            room, seed = room - len(docs[d]), d if seed is None else seed
    got = [d for d, *_ in p.done]
    assert [d for i, d in enumerate(got) if not i or got[i - 1] != d] == want


def share_a_window(rows, pairs):
    at = defaultdict(set)
    for r in rows:
        at[r.doc_id].add(r.sequence_id)
    return np.mean([bool(at[a] & at[b]) for a, b in pairs])


@pytest.mark.parametrize("shard", [16, 2048])
def test_near_copies_share_windows_whatever_the_shards(spark, shard):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts = docs + [(i + 1_000_000, t + " end") for i, t in docs]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    copies = defaultdict(list)
    for i, t in docs:
        copies[t].append(i)
    pairs = [(i, i + 1_000_000) for i, t in docs if len(copies[t]) == 1]
    assert share_a_window(P.pack(df, PATH, shard_docs=shard).collect(), pairs) >= 0.9


def test_neighbours_by_topic(spark):
    r = np.random.default_rng(4)
    texts = [(i, " ".join("".join(r.choice(list(("bdeo", "fgau", "klim", "prst")[i % 4]), 6)) for _ in range(60))) for i in range(160)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = P.pack(df, PATH).collect()
    check(rows, texts)
    seed = {x.sequence_id: x.doc_id for x in rows if x.role == "seed" and x.offset == 0}
    near = [x.doc_id % 4 == seed[x.sequence_id] % 4 for x in rows if x.role == "neighbour" and x.sequence_id in seed]
    assert len(near) > 80 and np.mean(near) > 0.8


def test_hot_copies_are_spread(spark):
    df = spark.range(4000).selectExpr("cast(null as long) as doc_id", "if(id % 3 = 0, 'one and the same text of many rows', concat('text number ', id)) as text")
    rows = P.pack(df, PATH, shard_docs=50).collect()
    assert sum(r.length == r.doc_tokens or r.length < r.doc_tokens for r in rows) == len(rows)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_best_first_is_a_stable_sort():
    r = np.random.default_rng(11)
    for n in (0, 1, 5, 8, 9, 300):
        at, cost = np.sort(r.permutation(1000)[:n]), r.integers(0, 9, n).astype(float)
        assert list(P.best_first(at, cost, 4)) == at[np.argsort(cost, kind="stable")].tolist()


@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_keys_and_bags_by_definition(kind):
    r = np.random.default_rng(12)
    ids = [r.integers(0, 300, n).astype(kind) for n in (1, 2, 3, 4, 90, 1, 700, 2)]
    idf = np.round(r.random(300), 1)
    key0, key1, _, bags = P.describe(ids, idf, 50.0, 8)
    for x, *keys, got in zip(ids, key0, key1, bags):
        grams = [x[i : i + 3] for i in range(max(len(x) - 2, 1))]
        h = np.array([sum((int(v) + 1) * int(o) for v, o in zip(g, P._ODD)) % 2**64 for g in grams], np.uint64)
        assert [int(np.uint64(k.astype(np.uint64))) for k in keys] == [int(P.mix64(h ^ P._SALTS[k]).min()) for k in range(2)]
        term, tf = np.unique(x, return_counts=True)
        weight = P.bm25(idf, term.astype(int), tf, len(x), 50.0)
        best = sorted(sorted(range(len(term)), key=lambda i: (-weight[i], term[i]))[:8])
        assert P.read_bag(got).tolist() == [[term[i], tf[i]] for i in best]
