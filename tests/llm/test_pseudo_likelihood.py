import math
import random
from collections import Counter

import numpy as np

from loomlake.llm import pseudo_likelihood as P


def folds(df):
    return {r.doc_id: r.fold for r in df.select("doc_id", P.fold_of("text", 2).alias("fold")).collect()}


def texts(n=300, seed=0):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(" ".join(w for _ in range(r.randrange(2, 30)) for w in r.choice(["the cat sat", "A dog RAN off", "x y"]).split()))
    return out


def test_gradients_by_differences():
    t = [x.encode() for x in texts(6)]
    h = np.unique(P.word_hashes(t)[0])
    net = P.Network(h[:-2], width=4, per_class=3)
    for n in P.Network.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    tokens, n = net.tokens(t)
    at = P.places(n)
    loss = lambda: -net.log_probabilities(tokens, at).astype(np.float64).mean()
    for w, g in zip(net.weights(), net.gradients(tokens, at)):
        for i in np.random.default_rng(0).integers(0, w.size, 8):
            old, eps = w.flat[i], 1e-3
            w.flat[i] = old + eps
            up = loss()
            w.flat[i] = old - eps
            down = loss()
            w.flat[i] = old
            assert abs((up - down) / (2 * eps) - g.flat[i]) < 1e-3


def brute(net, text):
    tokens, n = net.tokens([text.encode()])
    total = 0.0
    for i in range(2, 2 + int(n[0])):
        h = np.tanh(sum(net.embed[k][tokens[i + p]].astype(float) for k, p in enumerate(P.PLACES)) + net.bias)
        c, w = divmod(int(tokens[i]), net.per_class)
        a, b = h @ net.to_class + net.class_bias, h @ net.to_word[c] + net.word_bias[c]
        total += a[c] - math.log(np.exp(a).sum()) + b[w] - math.log(np.exp(b).sum())
    return total


def test_scores(spark):
    rows = [(i, t, "q") for i, t in enumerate(texts())]
    edge = [(900, None, "q"), (901, " \n ", "q"), (902, "the cat sat " * 50000, "q"), (None, "the cat", "q"), (903, "the sat ran cat dog y x a", "q")]
    df = spark.createDataFrame(rows + edge, "doc_id long, text string, n_tokens string").repartition(3)
    counts = {r.h: r.n for r in P.count_words(df).collect()}
    assert sorted(counts.values()) == sorted(Counter(w.lower() for _, t, _ in rows + edge for w in (t or "").split()).values())
    nets, fold = P.fit(df, vocabulary=20, per_class=4), folds(df)
    got = {r.doc_id: r for r in P.score(df, nets).collect()}
    for i, t, _ in rows[:20]:
        assert got[i].n_tokens == len(t.split()) and abs(got[i].sum_logprob - brute(nets[fold[i]], t)) < 1e-2
    assert got[900].n_tokens == got[901].n_tokens == 0 and got[901].mean_logprob is None and got[902].n_tokens == 150000
    usual = np.mean([got[i].mean_logprob for i, _, _ in rows])
    assert usual > math.log(1 / 11) and got[903].mean_logprob < usual - 0.5
    assert P.score(df.limit(0), P.fit(df.limit(0))).count() == 0


def test_unknown_words_are_spelled(spark):
    r = random.Random(1)
    stems = [a + b + c for a in ("ma", "re", "to", "li") for b in ("na", "ter", "so") for c in ("da", "ling", "n", "ro")]
    prose = lambda: " ".join(r.choice(["the", "a"]) + " " + r.choice(stems) for _ in range(30))
    rows = [(i, prose()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nets = P.fit(df, vocabulary=3, per_class=2)
    more = [(900, " ".join("".join(r.choices("qxzjkvw0987#%", k=8)) for _ in range(60))), (901, "the manada"), (902, "the qzxj#9")]
    whole = df.union(spark.createDataFrame(more, df.schema))
    got, net = {x.doc_id: x for x in P.score(whole, nets).collect()}, nets[folds(whole)[902]]
    assert got[900].mean_logprob < min(got[i].mean_logprob for i in range(200)) - 1
    assert got[901].mean_logprob > got[902].mean_logprob
    tokens, n = net.tokens([b"the qzxj#9"])
    plain = net.log_probabilities(tokens, P.places(n)).sum()
    word = [256, *b"qzxj#9", 256]
    assert abs(got[902].sum_logprob - plain - sum(net.pairs[a * 257 + b] for a, b in zip(word, word[1:]))) < 1e-3


def test_networks_do_not_depend_on_partitions(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (P.fit(df.repartition(n), vocabulary=8, per_class=4, words_per_slice=300) for n in (1, 6))
    assert all(np.array_equal(x.flat(), y.flat()) and np.array_equal(x.pairs, y.pairs) for x, y in zip(a, b))
    assert not np.array_equal(a[0].flat(), a[1].flat())
    one = df.where("doc_id = 3")
    assert P.score(one, P.fit(one)).count() == 1


def test_a_text_is_scored_by_what_has_not_seen_it(spark):
    rows = [(i, t) for i, t in enumerate(texts(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = folds(df)
    nets = P.fit(df, vocabulary=8, per_class=4)
    other = P.fit(df.join(spark.createDataFrame([(i,) for i, f in fold.items() if f == 1], "doc_id long"), "doc_id"), vocabulary=8, per_class=4)
    if (nets[0].words == other[0].words).all():
        assert np.allclose(nets[0].flat(), other[0].flat(), atol=0.2)


def test_noise_is_less_likely_than_the_corpus(spark):
    """Made-up words score below nearly all documents of a corpus; large logits stay finite."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    nets = P.fit(df)
    r = random.Random(3)
    noise = [(-1, " ".join("zq%dxv" % r.randrange(100) for _ in range(300))), (-2, " ".join("".join(r.choices("qxzjkvw0987#%", k=7)) for _ in range(300)))]
    got = P.score(df.union(spark.createDataFrame(noise, df.schema)), nets).collect()
    usual = [x.mean_logprob for x in got if x.doc_id >= 0 and x.n_tokens >= 20]
    assert all(x.mean_logprob < np.quantile(usual, 0.05) for x in got if x.doc_id < 0)
    net = nets[0]
    net.to_class = net.to_class * 1e6
    tokens, n = net.tokens([b"the the a the"])
    assert np.isfinite(net.log_probabilities(tokens, P.places(n))).all()
