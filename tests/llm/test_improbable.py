import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loomlake.llm import improbable as S


def test_entropy_levels():
    data = np.frombuffer(bytes(random.Random(1).choices(b"abcdefgh xyz", k=400)) + bytes(100) + b"the end of it " * 9, np.uint8)
    got = S.entropy_levels(data)
    for i in range(0, len(got), 7):
        c = Counter(data[i : i + 64].tolist()).values()
        h = 6 - sum(x * np.log2(x) for x in c) / 64
        assert abs(got[i] - h / 6 * S.LEVELS) < 2


def brute_features(text, rank):
    if not text:
        return []
    if len(text) < 127:
        return [(0, len(text))]
    level = S.entropy_levels(np.frombuffer(text, np.uint8))
    best = [min(range(i, i + 64), key=lambda p: (rank[level[p]], p)) for i in range(len(level) - 63)]
    return sorted((p, 64) for p, n in Counter(best).items() if n >= S.POPULAR) or [(0, 64)]


def test_features_by_brute_force():
    r = random.Random(2)
    texts = [bytes(r.choices(b"etaoin shrdlu.,\n", k=k)) for k in (0, 1, 63, 64, 126, 127, 128, 500, 3000)]
    rank = S.rarity(np.random.default_rng(0).integers(0, 1000, S.LEVELS))
    owner, h = S.features(texts, rank)
    for i, t in enumerate(texts):
        d = np.frombuffer(t, np.uint8)
        want = [S.span_hashes(d, np.array([a]), np.array([a + n]))[0] for a, n in brute_features(t, rank)]
        assert h[owner == i].tolist() == want
    whole = S.filters(texts, rank)
    assert all((a == b).all() for t, a in zip(texts, whole) for b in S.filters([t], rank))


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_rows(spark, buckets):
    r = random.Random(buckets)
    ids = [*r.sample(range(-(1 << 60), 1 << 60), 50), *range(30)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "n")], "doc_id long, text string")
    got = [tuple(x) for x in S.with_next(df, buckets).orderBy("bucket", "guest", "k").select("bucket", "guest", "doc_id").collect()]
    own = [x for x in got if not x[1]]
    assert [x[2] for x in own] == [None, *sorted(ids)]
    follow = [(a[2], b[2]) for a, b in zip(got, got[1:] + got[:1]) if not a[1] and a[0] == b[0]]
    assert sorted(follow, key=str) == sorted(zip([None, *sorted(ids)], [*sorted(ids), None]), key=str)


def test_rows(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("etaoin shrdluéü.,\n", k=k)) for k in (4000, 0, 5, 40, 900, 30000, 4000)]
    texts += [None, texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket int")
    rows = sorted(S.compare_edited(df).collect(), key=lambda x: x.doc_id)
    plain = [t or "" for t in texts]
    for i, x in enumerate(rows):
        k = len(plain[i]) // 4
        edited = plain[i][: len(plain[i]) - k] + plain[(i + 1) % len(plain)][:k]
        assert x.n_chars == len(plain[i]) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    assert rows[0].fingerprint == rows[8].fingerprint == rows[9].fingerprint and rows[8].near_next == 1
    assert rows[5].near_edited > 0.5 and rows[5].near_next < 0.2 and rows[0].near_edited > 0.5
    one = S.compare_edited(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert S.compare_edited(df.limit(0)).count() == 0


def test_texts_without_popular_windows():
    r = random.Random(7)
    rank = S.rarity(np.random.default_rng(0).integers(0, 1000, S.LEVELS))
    head = bytes(r.choices(b"etaoin shrdlu", k=64))
    for size in (100, 127, 135, 141):
        a, b = (head + bytes(r.choices(b"etaoin shrdlu", k=size - 64)) for _ in range(2))
        x, y, part = S.filters([a, b, a[: size - size // 5] + b[size - size // 5 :]], rank)
        assert S.likeness(x, y) < 0.8 and (size < 127 or S.likeness(x, part) > 0.2)
    a, b = head + b"cc by " * 50, head + b"gpl 2 " * 50
    assert S.likeness(*S.filters([a, b], rank)) < 1
    whole = S.filters([a, b, head], rank)
    assert all((p == S.filters([t], rank)[0]).all() for t, p in zip([a, b, head], whole))


def bits_of(text, rank):
    """The chain of a text's filters as sets of bits, from its features one by one."""
    _, h = S.features([text], rank, rare=True)
    chain = []
    for i, x in enumerate(h.tolist()):
        if i % S.PER_FILTER == 0:
            chain.append(set())
        chain[-1] |= {(x >> 11 * k) % S.BITS for k in range(S.HASHES)}
    return chain


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        best = 0.0
        for y in b:
            chance = len(x) * len(y) / S.BITS
            most = min(len(x), len(y)) - chance
            best = max(best, (len(x & y) - chance) / most if most > 0 else float(x <= y))
        total += min(max(best, 0.0), 1.0)
    return total / len(a)


def test_likeness_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()] + [(10**9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rank = S.fit(df)
    got = {r.doc_id: r for r in S.compare_edited(df).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        own = bits_of(t.encode(), rank)
        assert abs(got[i].near_edited - brute_likeness(own, bits_of(edited.encode(), rank))) < 1e-9
        assert abs(got[i].near_next - brute_likeness(own, bits_of(after.encode(), rank))) < 1e-9
