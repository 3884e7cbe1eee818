"""LM scoring by masked pseudo-likelihood.

A small network predicts each word of a text from the two words before and the two behind it. The sum of the log
probabilities of all words, each masked in turn, scores the document.

* Vocabulary: the most frequent words by counts over all documents; all others are one token to the network, and are
  spelled: to that token's log probability comes that of each byte, and of the word's end, after the byte before. Byte
  pairs are counted over all such words of all documents, so every word costs its own log probability.
* Network, in numpy: an embedding for each of four places, their sum through tanh, and a softmax over classes of words,
  then over the words of the class.
* Training: documents are dealt by hash to folds, rounds and slices of about ``words_per_slice`` words. In a round each
  slice trains a copy from the same start on all windows of its documents, in order of their hash (AdaGrad); the copies
  are averaged, weighted by their windows, and start the next round. Sums are of whole numbers, so networks do not depend
  on how the input is partitioned. Every document is trained on once; the number of slices and copies grows with the input.
* Scores: a fold is a hash of the text, and a text is scored by the network of the other folds, which has not seen it.
  Where all documents have one text, its own network has to do.

Null and empty texts have 0 tokens, sum 0 and mean null. Repeated rows get equal results, and train in one slice; ties
of the vocabulary go to the smaller hash; an empty table gives an empty table. Very long texts are cut into blocks only
for arithmetic: windows reach across. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, drop_cut, joined, ragged, span_hashes, texts_of
from loomlake.llm.ngram_join import _LOWER, _SPACE
from loomlake.llm.token_fst import groups

PLACES = (-2, -1, 1, 2)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in lower case, where words start and end, and how many words each text has."""
    data, offsets = joined([t + b" " for t in texts])
    data = _LOWER[data]
    inside = np.concatenate([[False], ~_SPACE[data]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    return data, starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and how many each text has."""
    data, starts, ends, n = word_spans(texts)
    return span_hashes(data, starts, ends), n


#: Stands before the first and behind the last byte of a word.
_END = 256
_SYMBOLS = 257


def byte_pairs(texts: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(word, pair) of the byte pairs of all words outside the sorted hashes, and the number of all words."""
    data, starts, ends, _ = word_spans(texts)
    h = span_hashes(data, starts, ends)
    unknown = np.flatnonzero(~np.isin(h, words))
    size = ends[unknown] - starts[unknown] + 1
    at = ragged(starts[unknown], size)
    last = np.cumsum(size) - 1
    after = data[at].astype(np.int64)
    after[last] = _END
    before = data[at - 1].astype(np.int64)
    before[last - size + 1] = _END
    return np.repeat(unknown, size), before * _SYMBOLS + after, len(h)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n) over all documents."""

    def run(rows):
        held, counts, size = [], [], 0

        def merged():
            h, at = np.unique(np.concatenate(held), return_inverse=True)
            return h, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        for b in batches(rows):
            texts = texts_of(b.column(0))
            h, n = np.unique(np.concatenate([word_hashes(texts[i:j])[0] for i, j in groups(texts, 1_000_000)]), return_counts=True)
            held.append(h)
            counts.append(n)
            size += len(h)
            if size > 1_000_000:
                h, n = merged()
                held, counts, size = [h], [n], len(h) // 2
                if len(h) > 1_000_000:
                    yield _counts(h, n)
                    held, counts, size = [], [], 0
        if held:
            yield _counts(*merged())

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _counts(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def _log_share(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log softmax of each row at its k."""
    z = z - z.max(1, keepdims=True)
    return z[np.arange(len(z)), k] - np.log(np.exp(z).sum(1))


class Network:
    """Token 0 stands for words outside the vocabulary, token ``size`` for what is beyond a text's ends; ``pairs`` holds
    the log probabilities of the byte pairs of words outside the vocabulary."""

    NAMES = ("embed", "bias", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, vocabulary: np.ndarray, width: int = 16, per_class: int = 32, seed: int = 3):
        self.words = np.sort(vocabulary.astype(np.uint64))
        self.pairs = np.full(_SYMBOLS * _SYMBOLS, -np.log(_SYMBOLS))
        self.per_class = per_class
        self.classes = -(-(len(vocabulary) + 1) // per_class)
        self.size = self.classes * per_class
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.embed, self.bias = f(len(PLACES), self.size + 1, width), np.zeros(width, np.float32)
        self.to_class, self.class_bias = f(width, self.classes), np.zeros(self.classes, np.float32)
        self.to_word, self.word_bias = f(self.classes, width, per_class), np.zeros((self.classes, per_class), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n, w in zip(self.NAMES, self.weights()):
            setattr(self, n, flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts with two marks around each, and the number of words of each."""
        h, n = word_hashes(texts)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            token = np.where(self.words[at] == h, at + 1, 0)
        else:
            token = np.zeros(len(h), np.int64)
        out = np.full(len(h) + 2 * len(texts) + 2, self.size, np.int64)
        text = np.repeat(np.arange(len(texts)), n)
        out[np.arange(len(h)) + 2 * text + 2] = token
        return out, n

    def spelled(self, texts: list[bytes]) -> np.ndarray:
        """The log probability of each word's bytes, 0 for words of the vocabulary."""
        word, pair, n = byte_pairs(texts, self.words)
        return np.bincount(word, self.pairs[pair], n)

    def _hidden(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.embed[k][tokens[at + p]] for k, p in enumerate(PLACES)) + self.bias)

    def _segments(self, cls: np.ndarray):
        order = np.argsort(cls.astype(np.int16), kind="stable")
        edge = np.searchsorted(cls[order], np.arange(self.classes + 1))
        return order, [(c, edge[c], edge[c + 1]) for c in range(self.classes) if edge[c] < edge[c + 1]]

    def log_probabilities(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(token at each place | the tokens around it)."""
        out = np.empty(len(at), np.float32)
        for i in range(0, len(at), 1 << 15):
            a = at[i : i + (1 << 15)]
            target = tokens[a]
            h, cls, word = self._hidden(tokens, a), target // self.per_class, target % self.per_class
            z = h @ self.to_class + self.class_bias
            p = _log_share(z, cls)
            order, segments = self._segments(cls)
            h, word = h[order], word[order]
            for c, s, e in segments:
                z = h[s:e] @ self.to_word[c] + self.word_bias[c]
                p[order[s:e]] += _log_share(z, word[s:e])
            out[i : i + len(a)] = p
        return out

    def gradients(self, tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log probability of the tokens at the places."""
        target = tokens[at]
        cls, word = target // self.per_class, target % self.per_class
        h = self._hidden(tokens, at)
        n = np.float32(len(at))

        def softmax_error(z, k):
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(z)), k] -= 1
            return z / n

        e = softmax_error(h @ self.to_class + self.class_bias, cls)
        g_class, g_class_bias, back = h.T @ e, e.sum(0), e @ self.to_class.T
        g_word, g_word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        order, segments = self._segments(cls)
        hs, ws = h[order], word[order]
        for c, s, t in segments:
            e = softmax_error(hs[s:t] @ self.to_word[c] + self.word_bias[c], ws[s:t])
            g_word[c], g_word_bias[c] = hs[s:t].T @ e, e.sum(0)
            back[order[s:t]] += e @ self.to_word[c].T
        back *= 1 - h * h
        g_embed = np.zeros_like(self.embed)
        for k, p in enumerate(PLACES):
            context = tokens[at + p]
            order = np.argsort(context.astype(np.int16 if self.size < 1 << 15 else np.int32), kind="stable")
            own, first = np.unique(context[order], return_index=True)
            g_embed[k][own] = np.add.reduceat(back[order], first, axis=0)
        return [g_embed, back.sum(0), g_class, g_class_bias, g_word, g_word_bias]


class Trainer:
    def __init__(self, network: Network, rate: float = 0.2, step: int = 8192):
        self.net, self.rate, self.step = network, rate, step
        self.squares = [np.full_like(w, 1e-6) for w in network.weights()]
        self.windows = 0

    def feed(self, tokens: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(at), self.step):
            part = at[i : i + self.step]
            for w, s, g in zip(self.net.weights(), self.squares, self.net.gradients(tokens, part)):
                s += g * g
                w -= self.rate * g / np.sqrt(s)
            self.windows += len(part)


def places(n: np.ndarray) -> np.ndarray:
    """Where the words of texts with n words stand among the tokens."""
    return np.arange(int(n.sum())) + 2 * np.repeat(np.arange(len(n)), n) + 2


_SCALE = 1 << 16


def fold_of(text: str, folds: int):
    return F.pmod(F.xxhash64(F.col(text)), F.lit(folds)).cast("int")


def _trained(rows: DataFrame, shared) -> DataFrame:
    """rows (fold, slice, text), all of a slice in one task and in order -> (fold, kind, at, x, windows): sums of weights
    times windows as whole numbers (kind 0), counts of byte pairs (kind 1)."""
    names = ["fold", "kind", "at", "x"]

    def results(fold, trainer, pairs):
        flat = np.round(trainer.net.flat().astype(np.float64) * _SCALE).astype(np.int64) * trainer.windows
        seen = np.flatnonzero(pairs)
        for kind, at, x in ((0, np.arange(len(flat)), flat), (1, seen, pairs[seen]), (2, np.zeros(1, np.int64), np.array([trainer.windows]))):
            for i in range(0, len(at), 1 << 16):
                k = len(at[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([fold] * k, pa.int32()), pa.array([kind] * k, pa.int32()), pa.array(at[i : i + k]), pa.array(x[i : i + k])], names)

    def run(batches_):
        now, held, size, trainer, pairs = None, [], 0, None, None

        def feed():
            tokens, n = trainer.net.tokens(held)
            trainer.feed(tokens, places(n))
            pairs[:] += np.bincount(byte_pairs(held, trainer.net.words)[1], minlength=len(pairs))

        for b in batches(batches_):
            for fold, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2))):
                if (fold, part) != now:
                    if now is not None:
                        feed()
                        yield from results(now[0], trainer, pairs)
                    base = shared.value[fold]
                    net = Network(base.words, base.bias.size, base.per_class)
                    net.load(base.flat())
                    now, held, size, trainer, pairs = (fold, part), [], 0, Trainer(net), np.zeros(_SYMBOLS * _SYMBOLS, np.int64)
                held.append(text)
                size += len(text)
                if size > 1_000_000:
                    feed()
                    held, size = [], 0
        if now is not None:
            feed()
            yield from results(now[0], trainer, pairs)

    out = rows.mapInArrow(run, "fold int, kind int, at long, x long")
    return out.groupBy("fold", "kind", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x"))


def fit(df: DataFrame, vocabulary: int = 1023, words_per_slice: int = 2_000_000, rounds: int = 2, folds: int = 2, id_col: str = "doc_id", text_col: str = "text", **shape) -> list[Network]:
    """For each fold the network that scores its texts: the one trained on the other folds."""
    spark = df.sparkSession
    docs = df.select(F.col(text_col).alias("text"), fold_of(text_col, folds).alias("fold"), F.xxhash64(id_col, text_col, F.lit(5)).alias("h")).where("text is not null")
    counts = cut(count_words(docs))
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "h").limit(vocabulary).collect()
    drop_cut(counts)
    nets = [Network(np.array([r.h for r in top], np.int64).view(np.uint64), **shape) for _ in range(folds)]
    slices = -(-total // (folds * rounds * words_per_slice))
    if not total:
        return nets
    dealt = docs.select("fold", F.pmod("h", F.lit(rounds * slices)).cast("int").alias("slice"), "h", "text")
    pairs, trained = [np.full(_SYMBOLS * _SYMBOLS, 0.1) for _ in nets], [0] * folds
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(nets)
        # a document of fold f trains the networks of all other folds: with two, the one of the other fold
        own = dealt.where(F.col("slice") % rounds == r).withColumn("fold", F.explode(F.array_remove(F.array(*map(F.lit, range(folds))), F.col("fold"))) if folds > 2 else 1 - F.col("fold"))
        ordered = own.repartition("fold", "slice").sortWithinPartitions("fold", "slice", "h", "text").select("fold", "slice", "text")
        got = _trained(ordered, shared).toArrow()
        fold, kind, at, x = (got.column(c).to_numpy() for c in ("fold", "kind", "at", "x"))
        for f, net in enumerate(nets):
            windows = x[(fold == f) & (kind == 2)].sum()
            if windows:
                flat = np.zeros(len(net.flat()))
                here = (fold == f) & (kind == 0)
                flat[at[here]] = x[here]
                net.load(flat / windows / _SCALE)
                here = (fold == f) & (kind == 1)
                pairs[f][at[here]] += x[here]
                trained[f] += int(windows)
    for f, net in enumerate(nets):
        c = pairs[f].reshape(_SYMBOLS, _SYMBOLS)
        net.pairs = np.log(c / c.sum(1, keepdims=True)).ravel()
    best = int(np.argmax(trained))
    return [net if t else nets[best] for net, t in zip(nets, trained)]


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("sum_logprob", pa.float64()), ("mean_logprob", pa.float64())])


def score(df: DataFrame, networks: list[Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, sum_logprob, mean_logprob) of each row of df; each text by the network of its fold."""
    shared = df.sparkSession.sparkContext.broadcast(networks)

    def sums_of(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens, n = net.tokens(texts)
        p = net.log_probabilities(tokens, places(n)).astype(np.float64) + net.spelled(texts)
        ends, at = np.concatenate([[0.0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(n)])
        return ends[at[1:]] - ends[at[:-1]], n

    def run(rows):
        for b in batches(rows):
            texts, fold = texts_of(b.column(1)), b.column(2).to_numpy()
            n, s = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for f, net in enumerate(shared.value):
                own = np.flatnonzero(fold == f)
                mine = [texts[i] for i in own.tolist()]
                for i, j in groups(mine, 1_000_000):
                    s[own[i:j]], n[own[i:j]] = sums_of(net, mine[i:j])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s), pa.array(s / np.maximum(n, 1), mask=n == 0)], schema=_SCORES)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), fold_of(text_col, len(networks)).alias("fold"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, sum_logprob double, mean_logprob double")
