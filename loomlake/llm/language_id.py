"""Language ID by prediction by partial matching over bytes.

For each language a context tree of order ``order`` holds how often bytes follow each context, counted over a sample of
about ``per_language`` labelled documents (a documented bound; whole texts). The statistics are then frozen. The code
length of a text under a language is exact PPM without exclusions, escapes by method C: from the longest context that
the tree has, a byte seen there costs -log2(count / (total + distinct)), one not seen costs the escape
-log2(distinct / (total + distinct)) and is looked up in the next shorter context; below order 0 it costs 8 bits. The
language of least code length is predicted; the score is its posterior with equal priors.

Every byte sequence of the sample is kept, those seen once too. Each language has its own tree, kept as hash tables of
its sequences, so the model grows with the sum of the trees. A language whose sample has over ``max_nodes`` sequences
loses the rarest of them, whole counts at a time, until it fits; that bounds the broadcast, and at the defaults takes
samples of some hundred megabytes.

A null text, or one without a letter, is ``und`` with score 0; so is all text if nothing can be learned. Ties go to the
first language by name. Rows with a null id are predicted, not learned from. Repeated rows get equal results; an empty
table gives an empty table. Very long texts are scored in blocks that overlap by a context, to the same code length.
Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, drop_cut, joined, texts_of
from loomlake.llm.token_fst import groups

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))


def held_out(id_col: str = "doc_id"):
    """True for the documents that nothing is learned from."""
    return F.coalesce(F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 4 = 2"), F.lit(False))


def count_contexts(labelled: DataFrame, order: int) -> DataFrame:
    """labelled (lang, text) -> (lang, gram, n): byte sequences of 1 to order + 1 bytes. gram: length << 32 | bytes."""

    def run(rows):
        for b in batches(rows):
            langs = np.array(b.column(0).to_pylist(), object)
            texts = texts_of(b.column(1))
            for lang in sorted(set(langs)):
                data, offsets = joined([t for t, x in zip(texts, langs) if x == lang])
                first = np.zeros(len(data) + 1, np.int64)
                first[offsets[:-1]] = offsets[:-1]
                first = np.maximum.accumulate(first)[: len(data)]
                at, code = np.arange(len(data)), np.zeros(len(data), np.int64)
                grams = []
                for n in range(1, order + 2):
                    code = code | (np.concatenate([np.zeros(n - 1, np.int64), data[: max(len(data) - n + 1, 0)].astype(np.int64)])[: len(data)] << 8 * (n - 1))
                    grams.append(code[at - first >= n - 1] | n << 32)
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


_HASH = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 250_000
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF])


class Sequences:
    """A set of byte sequences of one length, looked up by number."""

    def __init__(self, codes: np.ndarray, length: int):
        self.codes = codes
        if length < 3:  # by the code itself
            self.at = np.full(1 << 8 * length, -1, np.int32)
            self.at[codes] = np.arange(len(codes))
            self.shift = None
            return
        bits = max(4, int(4 * len(codes)).bit_length())
        self.at, self.shift = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits)
        slot, left = self._slot(codes), np.arange(len(codes))
        while len(left):  # each free slot takes one of those that want it
            free = left[self.at[slot[left]] < 0]
            self.at[slot[free]] = free
            left = left[self.at[slot[left]] != left]
            slot[left] = slot[left] + 1 & len(self.at) - 1

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each sequence, -1 where there is none."""
        if self.shift is None:
            return self.at[codes]
        slot = self._slot(codes)
        out = self.at[slot]
        left = np.flatnonzero(out >= 0)
        left = left[self.codes[out[left]] != codes[left]]
        while len(left):
            slot[left] = slot[left] + 1 & len(self.at) - 1
            out[left] = self.at[slot[left]]
            left = left[out[left] >= 0]
            left = left[self.codes[out[left]] != codes[left]]
        return out


class Tree:
    """The frozen context tree of one language, from its sequences (length << 32 | bytes) and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order, length = order, grams >> 32
        self.sets, self.cost, self.escape = [], [], []
        before = None
        for n in range(1, order + 2):
            own = np.flatnonzero(length == n)
            own = own[np.argsort(grams[own])]
            codes, count = grams[own] & 0xFFFFFFFF, counts[own].astype(np.float64)
            up = np.zeros(len(codes), np.int64) if n == 1 else before.find(codes >> 8)
            size = 1 if n == 1 else max(1, len(before.codes))
            total, distinct = np.bincount(up, count, size), np.bincount(up, minlength=size)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.escape.append(np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0).astype(np.float32))
            self.cost.append(-np.log2(count / (total + distinct)[up]).astype(np.float32))
            before = Sequences(codes, n)
            self.sets.append(before)

    def costs(self, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Bits of each byte. code: it and the three before it; depth: how many stand before it in its text."""
        out, todo = np.zeros(len(code), np.float32), np.arange(len(code))
        for k in range(self.order, -1, -1):
            now = todo[depth[todo] >= k]
            at = self.sets[k].find(code[now] & (1 << 8 * (k + 1)) - 1)
            out[now] += np.where(at >= 0, self.cost[k][at] if len(self.cost[k]) else 0, 0)
            miss = now[at < 0]
            if k:
                context = self.sets[k - 1].find(code[miss] >> 8 & (1 << 8 * k) - 1)
                out[miss] += np.where(context >= 0, self.escape[k][context], 0)
            else:
                out[miss] += self.escape[0][0] + 8
            todo = np.concatenate([todo[depth[todo] < k], miss])
        return out


class Model:
    """The trees of all languages."""

    def __init__(self, counts: list[tuple[str, int, int]] | dict[str, tuple[np.ndarray, np.ndarray]], order: int = 3):
        if not isinstance(counts, dict):
            by: dict[str, list] = {}
            for lang, gram, n in counts:
                by.setdefault(lang, []).append((gram, n))
            counts = {k: tuple(np.array(v, np.int64).T) for k, v in by.items()}
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[k], order) for k in self.langs]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        for i, j in groups(texts, BLOCK):
            data, offsets = joined(texts[i:j])
            text = np.repeat(np.arange(j - i), np.diff(offsets))
            for at in range(0, len(data), BLOCK):
                stop, back = min(len(data), at + BLOCK), min(at, 3)
                part = data[at - back : stop].astype(np.int64)
                code = part.copy()
                for k in (1, 2, 3):
                    code[k:] |= part[:-k] << 8 * k
                own = text[at:stop]
                depth = np.minimum(np.arange(at, stop) - offsets[own], 3)
                # what a byte costs depends on it and its context: each such case is looked up once
                case, same = np.unique(depth << 32 | code[back:] & _MASKS[depth], return_inverse=True)
                for x, tree in enumerate(self.trees):
                    out[i:j, x] += np.bincount(own, tree.costs(case & 0xFFFFFFFF, case >> 32)[same], j - i)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = self.bits(texts)
        best = bits.argmin(1)
        score = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
        known = np.array([has_letter(t) for t in texts], bool)
        return [self.langs[i] if ok else UNDETERMINED for i, ok in zip(best, known)], np.where(known, score, 0.0)


def fit(df: DataFrame, order: int = 3, per_language: int = 400, max_nodes: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the labelled documents that are not held out. A language with at most ``per_language`` of them gives all."""
    if not 0 <= order <= 3:
        raise ValueError("order is 0 to 3")
    usable = df.where(f"`{lang_col}` is not null and `{text_col}` is not null and `{id_col}` is not null").where(~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r.lang: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], order)
    rate = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    counts = cut(count_contexts(chosen.select("lang", "text"), order))
    found, least = {}, 1
    left = counts
    while True:
        nodes = {r.lang: r["n"] for r in left.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        fits = [k for k, n in nodes.items() if n <= max_nodes]
        for lang in fits:
            rows = left.where(F.col("lang") == lang).select("gram", "n").toArrow()
            found[lang] = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
        if len(fits) == len(nodes):
            break
        least += 1
        left = left.where(~F.col("lang").isin(fits) & (F.col("n") >= least))
    drop_cut(counts)
    return Model(found, order)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(rows):
        for b in batches(rows):
            lang, score = shared.value.predict(texts_of(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df with the predicted language in place of its own, without the rows that are undetermined. Column names are as
    they are, of whatever name; null ids and repeated rows stay."""
    shared, names = df.sparkSession.sparkContext.broadcast(model), df.columns
    at, to = names.index(text_col), names.index(lang_col)

    def run(rows):
        for b in batches(rows):
            for i in range(0, b.num_rows, 64):  # the rows go on with their texts: few at a time
                part = b.slice(i, 64)
                lang, _ = shared.value.predict(texts_of(part.column(at)))
                lang = pa.array([None if x == UNDETERMINED else x for x in lang], pa.string())
                yield part.set_column(to, pa.field(lang_col, pa.string()), lang).filter(lang.is_valid())

    return df.mapInArrow(run, df.schema)
