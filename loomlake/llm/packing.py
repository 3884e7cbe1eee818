"""Lexical retrieval packing: windows filled with documents that BM25 finds for a seed document.

1. Documents become token ids, kept as a table. Document frequencies over all documents give BM25 weights. Each document
   is described by its ``terms`` strongest ids (weights over its whole text) and by content keys.
2. The index is sharded by content and not by chance, so that neighbours meet whatever the number of shards. In each of
   the ``links`` rounds a shard holds the documents with one MinHash of token trigrams. A seed takes the shard's unused
   documents that score at least ``near`` of what it scores against itself, best first, until a window is full; they form
   a bundle, which the next round and packing treat as one. Two documents that share a fraction j of their trigrams miss
   each other with probability (1 - j)^links, whatever the size of the table.
3. Bundles are then ordered by two weighted MinHashes of their seed's terms, and runs of ``shard_docs`` of them are
   shards. The head of a window is its seed: the rest of what an earlier window had to cut, or the first unused bundle.
   It takes the unused ones of its shard, best score first, until the window is full (equal scores: order); the last one
   is cut. What is open at the end of a shard goes on in the next one. The last tokens of a task go to sequences of
   power-of-two lengths, which take no padding.

Shards are runs of a total order (key, place), so that a hot key is spread over shards and tasks, and a shard holds
``shard_docs`` descriptions at most. Nothing that grows with the input is broadcast or collected: the driver gets one
count for each vocabulary id.

A document is its ids, whole, and then ``end_id``; a very long one fills windows alone. Null texts are empty and have
that one id; repeated rows are packed each; null ids stay null; an empty table gives an empty table. Other columns, of
whatever name, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, drop_cut, mix64, ragged, release, texts_of
from loomlake.llm.token_fst import encoder, groups

K1, B = 1.2, 0.75
U = np.uint64
_LAST = U((1 << 64) - 1)
_ODD = mix64(np.arange(1, 4, dtype=U)) | U(1)
_SALTS = mix64(np.arange(11, 19, dtype=U))

_TOKENS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_ITEMS = pa.schema([("pos", pa.int64()), ("n", pa.int64()), ("key0", pa.int64()), ("key1", pa.int64()), ("topic", pa.int64()), ("bag", pa.binary()), ("members", pa.binary())])
_ITEM_ROWS = "pos long, n long, key0 long, key1 long, topic long, bag binary, members binary"
_PLACED = pa.schema([("pos", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("role", pa.string())])
_PLACED_ROWS = "pos long, start long, length long, sequence_id long, offset long, role string"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("role", pa.string())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, role string"
#: Bytes of text that a worker encodes at a time.
GROUP = 500_000
#: The content keys of the rounds that make bundles.
KEYS = ("key0", "key1")


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """docs (doc_id, text) -> id, place (partition << 33 | row), number of ids, ids (32-bit, or 16-bit if all fit)."""

    def run(rows):
        part, row = TaskContext.get().partitionId(), 0
        for b in batches(rows):
            e = encoder(path)
            kind = np.uint32 if max(max(e.bytes_of), end_id) >= 1 << 16 else np.uint16
            texts = texts_of(b.column(1))
            for i, j in groups(texts, GROUP):  # encoding takes some 100 bytes for each of theirs
                ids = [np.append(x, end_id).astype(kind) for x in e.encode(texts[i:j])]
                k = j - i
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k), pa.array(part << 33 | np.arange(row, row + k)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=_TOKENS)
                row += k

    return docs.mapInArrow(run, "doc_id long, pos long, n long, ids binary")


def read_ids(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32)


def _some(column: pa.Array, n: pa.Array) -> Iterator[list[np.ndarray]]:
    """The ids of documents, about 150,000 at a time: their arrays stay in a core's cache."""
    held, size = [], 0
    for x, k in zip(column, n.to_pylist()):
        held.append(read_ids(x.as_buffer(), k))
        size += k
        if size > 150_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pairs(ids: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The number of each document and its ids in one number each, and the bits of an id: 32 bits where both fit."""
    size = [len(x) for x in ids]
    flat = np.concatenate(ids)
    if flat.dtype == np.uint16 and len(ids) < 1 << 16:
        return np.repeat(np.arange(len(ids), dtype=np.uint32) << np.uint32(16), size) | flat, 16
    return np.repeat(np.arange(len(ids)) << 32, size) | flat.astype(np.int64), 32


def inverse_frequencies(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of each vocabulary id and the mean number of ids of a document."""

    def run(rows):
        seen = np.zeros(0, np.int64)
        for b in batches(rows):
            for ids in _some(b.column(1), b.column(0)):
                pair, bits = _pairs(ids)
                n = np.bincount(np.unique(pair) & pair.dtype.type((1 << bits) - 1))
                if len(n) > len(seen):
                    seen = np.concatenate([seen, np.zeros(len(n) - len(seen), np.int64)])
                seen[: len(n)] += n
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    got = tokens.select("n", "ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    idf = np.zeros(int(term.max()) + 1 if len(term) else 0)
    idf[term] = np.log1p((count - n + 0.5) / (n + 0.5))
    return idf, float(mean or 1.0)


def bm25(idf: np.ndarray, term, tf, length, mean: float) -> np.ndarray:
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def describe(ids: list[np.ndarray], idf: np.ndarray, mean: float, terms: int):
    """(key0, key1, topic, bag) of each document: MinHashes of trigrams; two weighted MinHashes of ids; the strongest ids
    and how often each occurs, as 32-bit numbers."""
    size = np.array([len(x) for x in ids], np.int64)
    first = np.cumsum(size) - size
    flat = np.concatenate(ids).astype(np.int64)
    h, after = (flat + 1).astype(U), (flat[1:] + 1).astype(U)
    h *= _ODD[0]
    h[:-1] += after * _ODD[1]
    h[:-2] += after[1:] * _ODD[2]
    # of a document's last two places none is the start of a trigram; a document of fewer ids is one by itself
    last, small = first + size - 1, size < 3
    no = np.concatenate([last, last[~small] - 1])
    own = np.array([sum((int(i) + 1) * int(o) for i, o in zip(x, _ODD)) % (1 << 64) for x in map(ids.__getitem__, np.flatnonzero(small))], U)
    keys = []
    for k in range(2):
        m = mix64(h ^ _SALTS[k])
        m[no] = _LAST
        m[first[small]] = mix64(own ^ _SALTS[k])
        keys.append(np.minimum.reduceat(m, first).view(np.int64))
    pair, bits = _pairs(ids)
    pair, tf = np.unique(pair, return_counts=True)
    doc, term = (pair >> pair.dtype.type(bits)).astype(np.int64), (pair & pair.dtype.type((1 << bits) - 1)).astype(np.int64)
    count = np.bincount(doc, minlength=len(ids))
    first = np.cumsum(count) - count
    weight = bm25(idf, term, tf, size[doc], mean)
    topic = np.zeros(len(ids), np.int64)
    for k in (2, 3):
        u = (mix64(term.astype(U) ^ _SALTS[k]) >> U(11)).astype(np.float64) + 1
        race = -np.log(u / float(1 << 53)) / np.maximum(weight, 1e-9)
        least = np.flatnonzero(race == np.repeat(np.minimum.reduceat(race, first), count))
        _, one = np.unique(doc[least], return_index=True)
        topic = topic << 31 | term[least[one]] & (1 << 31) - 1
    # by document and weight; ids are in order before
    order = np.argsort(-weight, kind="stable")
    order = order[np.argsort(doc[order].astype(np.min_scalar_type(len(ids))), kind="stable")]
    keep = np.sort(order[np.arange(len(order)) - first[doc] < terms])
    edge = np.searchsorted(doc[keep], np.arange(len(ids) + 1)).tolist()
    both = np.stack([term[keep], tf[keep]], 1).astype("<u4")
    return *keys, topic, [both[a:b].tobytes() for a, b in zip(edge, edge[1:])]


def described(tokens: DataFrame, shared, terms: int) -> DataFrame:
    """The items to be packed, one for each document."""

    def run(rows):
        idf, mean = shared.value
        for b in batches(rows):
            at = 0
            for ids in _some(b.column(2), b.column(1)):
                key0, key1, topic, bags = describe(ids, idf, mean, terms)
                pos, n = b.column(0).slice(at, len(ids)), b.column(1).slice(at, len(ids))
                at += len(ids)
                own = np.stack([pos.to_numpy(), n.to_numpy()], 1)
                yield pa.RecordBatch.from_arrays([pos, n, pa.array(key0), pa.array(key1), pa.array(topic), pa.array(bags, pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], schema=_ITEMS)

    return tokens.select("pos", "n", "ids").mapInArrow(run, _ITEM_ROWS)


class Index:
    """The inverted BM25 index of a shard: bags of (ids, how often) and the lengths of the documents."""

    def __init__(self, bags: list[np.ndarray], lengths: list[int], idf: np.ndarray, mean: float):
        self.n = len(bags)
        size = np.array([len(x) for x in bags], np.int64)
        both = np.concatenate(bags).astype(np.int64)
        doc = np.repeat(np.arange(self.n), size)
        weight = bm25(idf, both[:, 0], both[:, 1], np.repeat(np.asarray(lengths, np.float64), size), mean)
        order = np.argsort(both[:, 0], kind="stable")
        self.words, at = np.unique(both[order, 0], return_index=True)
        self.at, self.size = at, np.diff(np.append(at, len(order)))
        self.doc, self.weight = doc[order], weight[order]

    def scores(self, bag: np.ndarray) -> np.ndarray:
        """Of each document of the shard for the ids of a bag."""
        term = bag[:, 0].astype(np.int64)
        k = np.minimum(np.searchsorted(self.words, term), len(self.words) - 1)
        k = k[self.words[k] == term]
        n = self.size[k]
        end = np.cumsum(n)
        at = np.repeat(self.at[k] + n - end, n)
        at += np.arange(len(at))
        return np.bincount(self.doc[at], self.weight[at], self.n)


def read_bag(bag: bytes) -> np.ndarray:
    return np.frombuffer(bag, "<u4").reshape(-1, 2)


def bundled(rows: list[tuple], idf: np.ndarray, mean: float, window: int, near: float) -> list[tuple]:
    """One shard of items (pos, n, .., bag, members): seeds in order take what is near until they fill a window."""
    if len(rows) < 2:
        return rows
    bags = [read_bag(r[5]) for r in rows]
    # a bundle's length is that of its seed here
    lengths = [int(np.frombuffer(r[6], np.int64)[1]) for r in rows]
    index, used, out = Index(bags, lengths, idf, mean), np.zeros(len(rows), bool), []
    for i, row in enumerate(rows):
        if used[i]:
            continue
        used[i] = True
        n, members = row[1], [row[6]]
        if n < window or len(row[6]) == 16:
            score = index.scores(bags[i])
            found = np.flatnonzero((score >= near * score[i]) & ~used)
            for j in found[np.argsort(-score[found], kind="stable")].tolist():
                used[j] = True
                n += rows[j][1]
                members.append(rows[j][6])
                if n >= window:
                    break
        out.append((row[0], n, *row[2:6], b"".join(members)))
    return out


def _in_order(items: DataFrame, key: str, tasks: int) -> DataFrame:
    return items.repartitionByRange(tasks, key, "pos").sortWithinPartitions(key, "pos")


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns))


def linked(items: DataFrame, key: str, shared, tasks: int, window: int, shard: int, near: float) -> DataFrame:
    """Items bundled with what is near in their shard: the items of one key, at most ``shard`` in a run."""
    at = _ITEMS.get_field_index(key)

    def run(batches_):
        idf, mean = shared.value
        held, out = [], []

        def ready(least: int):
            nonlocal out
            while len(out) >= max(least, 1):
                part, out = out[:512], out[512:]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ITEMS)], schema=_ITEMS)

        for b in batches(batches_):
            for row in _rows(b):
                if held and (held[-1][at] != row[at] or len(held) == shard):
                    out += bundled(held, idf, mean, window, near)
                    held = []
                held.append(row)
            yield from ready(512)
        out += bundled(held, idf, mean, window, near)
        yield from ready(1)

    return _in_order(items, key, tasks).mapInArrow(run, _ITEM_ROWS)


def binary_tail(pieces: list[tuple], total: int, sequence: int) -> list[tuple]:
    """(pos, start, length, role) laid end to end in sequences of the powers of two that make up total."""
    out, left, cap, at = [], total, 0, 0
    for d, s, n, role in pieces:
        while n:
            if not cap:
                cap, at = 1 << (left.bit_length() - 1), 0
                left -= cap
            k = min(n, cap)
            out.append((d, s, k, sequence, at, role))
            s, n, cap, at = s + k, n - k, cap - k, at + k
            if not cap:
                sequence += 1
    return out


def best_first(at: np.ndarray, cost: np.ndarray, most: int = 64) -> Iterator[int]:
    """Places by least cost, equal ones in order. What lies behind the first ones is sorted only when it is asked for."""
    if len(at) > 2 * most:
        limit = np.partition(cost, most)[most]
        near = cost <= limit
        yield from at[near][np.argsort(cost[near], kind="stable")].tolist()
        at, cost = at[~near], cost[~near]
    yield from at[np.argsort(cost, kind="stable")].tolist()


class Packer:
    """Windows filled shard by shard; what is open at the end of a shard goes on in the next."""

    def __init__(self, idf: np.ndarray, mean: float, window: int, sequence: int = 0):
        self.idf, self.mean, self.window, self.sequence = idf, mean, window, sequence
        self.room, self.seed = window, None
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def lay(self, members: np.ndarray, bag: np.ndarray, role: str) -> bool:
        """Whether a window was filled."""
        filled = False
        for d, n in members.tolist():
            s = 0
            while s < n:
                k = min(self.room, n - s)
                self.open.append((d, s, k, role))
                s += k
                self.room -= k
                if not self.room:
                    at = 0
                    for p in self.open:
                        self.done.append((*p[:3], self.sequence, at, p[3]))
                        at += p[2]
                    self.open, self.room, filled, role = [], self.window, True, "seed"
                    self.sequence += 1
        if filled:
            self.seed = bag if self.room < self.window else None
        elif self.seed is None:
            self.seed = bag
        return filled

    def shard(self, rows: list[tuple]) -> None:
        """Pack all items (.., bag, members) of a shard."""
        bags, members = [read_bag(r[-2]) for r in rows], [np.frombuffer(r[-1], np.int64).reshape(-1, 2) for r in rows]
        index, free, first = Index(bags, [int(m[0, 1]) for m in members], self.idf, self.mean), np.ones(len(rows), bool), 0
        while True:
            while first < len(rows) and not free[first]:
                first += 1
            if first == len(rows):
                return
            if self.seed is None:
                free[first] = False
                self.lay(members[first], bags[first], "seed")
                continue
            at = np.flatnonzero(free)
            for i in best_first(at, -index.scores(self.seed)[at]):
                free[i] = False
                if self.lay(members[i], bags[i], "neighbour"):
                    break

    def finish(self) -> None:
        if self.open:
            self.done += binary_tail(self.open, self.window - self.room, self.sequence)
            self.open = []


def windows(items: DataFrame, shared, tasks: int, window: int, shard: int) -> DataFrame:
    """(pos, start, length, sequence_id, offset, role) of every piece."""

    def run(batches_):
        p, held = Packer(*shared.value, window, TaskContext.get().partitionId() << 33), []

        def ready():
            rows, p.done = p.done, []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PLACED)], schema=_PLACED)

        for b in batches(batches_):
            for row in _rows(b):
                held.append(row)
                if len(held) == shard:
                    p.shard(held)
                    held = []
            yield from ready()
        if held:
            p.shard(held)
        p.finish()
        yield from ready()

    return _in_order(items, "topic", tasks).select("bag", "members").mapInArrow(run, _PLACED_ROWS)


def checked(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pieces with their documents' ids and checksums. A document meets the list of its pieces once."""
    lists = pieces.groupBy("pos").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "role")).alias("pieces"))

    def run(rows):
        for b in batches(rows):
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
            start, length, *where = b.column(3).flatten().flatten()
            size = b.column(1).to_pylist()
            ids = [read_ids(x.as_buffer(), n) for x, n in zip(b.column(2), size)]
            crc = [zlib.crc32(ids[i][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(of.tolist(), start.to_pylist(), length.to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), start, length, pa.array(crc, pa.int64()), b.column(1).take(pa.array(of)), *where], schema=PIECE_SCHEMA)

    return tokens.join(lists, "pos").select("doc_id", "n", "ids", "pieces").mapInArrow(run, _PIECES)


def pack(
    df: DataFrame, path: str, window: int = 2048, end_id: int = 1, shard_docs: int = 2048, terms: int = 64, links: int = 2, near: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, role) of every piece of every document."""
    if not 0 <= links <= len(KEYS):
        raise ValueError(f"links is 0 to {len(KEYS)}")
    docs = df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    tokens = cut(tokenized(docs, path, end_id))
    tasks = max(1, tokens.rdd.getNumPartitions())
    shared = df.sparkSession.sparkContext.broadcast(inverse_frequencies(tokens))
    items = cut(described(tokens, shared, terms))
    for key in KEYS[:links]:
        last, items = items, cut(linked(items, key, shared, tasks, window, shard_docs, near))
        drop_cut(last)
        release(df.sparkSession)
    # no more tasks than full shards: else a small table's shards would be the smaller, the more tasks it has
    tasks = min(tasks, -(-tokens.count() // shard_docs) or 1)
    pieces = cut(windows(items, shared, tasks, window, shard_docs))
    drop_cut(items)
    release(df.sparkSession)
    return checked(pieces, tokens)
