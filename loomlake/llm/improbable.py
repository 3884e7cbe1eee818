"""Document fingerprints from statistically improbable features.

Every 64-byte window of a text has an entropy. How rare each entropy level is comes from a count over all windows of
all documents, frozen before fingerprints are made. A window is selected if it is the rarest (first on ties) of its
neighbourhood for at least ``POPULAR`` of 64 consecutive neighbourhoods. A text of a window or more where none is so
popular has the rarest window of each ``POPULAR`` consecutive ones (of all, if there are fewer) instead. Selected windows are hashed and inserted, in
order, into a chain of Bloom filters of 2048 bits, 160 features each. Likeness is the overlap of bits, less what chance
gives, over the most there could be: for each filter of the shorter chain the best of the other, averaged.

A text shorter than a window is one feature; an empty or null text has none, and two of these are alike (1), one and
another text are not (0). Order: by id (null first), then text. Equal texts have equal fingerprints. A single row is its
own next one; an empty table gives an empty table. Rows of one id are in one task, so an id is not expected to repeat
without bound; very long texts are taken whole, one at a time. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches, joined, mix64, span_hashes, texts_of
from loomlake.llm.token_fst import groups

WINDOW, POPULAR, BITS, PER_FILTER, HASHES = 64, 16, 2048, 160, 5
LEVELS = 1024
_GAIN = np.zeros(WINDOW + 2, np.int64)
_XLOGX = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 3))])
_GAIN[:] = np.round((_XLOGX[1 : WINDOW + 3] - _XLOGX[: WINDOW + 2]) * 1024)
#: Windows of less entropy (runs of few bytes) stand behind all others.
_WEAK = 2.0


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte, by sliding sums of c log c."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW + 1):
        if k >= n:
            break
        same = (data[k:] == data[:-k]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    first = np.bincount(data[:WINDOW], minlength=256)
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = sum(int(_GAIN[:c].sum()) for c in first)
    np.cumsum(_GAIN[before[WINDOW:]] - _GAIN[after[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    # c log c is 0 for 64 different bytes and 64 * 6 * 1024 for 64 equal ones
    return np.minimum((WINDOW * 6 * 1024 - total) * LEVELS // (WINDOW * 6 * 1024), LEVELS - 1).astype(np.int32)


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each level."""

    def run(rows):
        out = np.zeros(LEVELS, np.int64)
        for b in batches(rows):
            texts = texts_of(b.column(0))
            for i, j in groups(texts, 1_000_000):
                data, offsets = joined(texts[i:j])
                level = entropy_levels(data)
                ok = np.ones(len(level), bool)
                for e in offsets[1:-1]:
                    ok[max(0, e - WINDOW + 1) : e] = False
                out += np.bincount(level[ok], minlength=LEVELS)
        at = np.flatnonzero(out)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r.level] = r.n
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each level, 0 for the rarest."""
    weak = np.arange(LEVELS) < _WEAK / 6 * LEVELS
    order = np.lexsort((np.arange(LEVELS), counts, weak))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    return rank


def rare_windows(text: bytes, rank: np.ndarray) -> np.ndarray:
    """Where the rarest of each POPULAR consecutive windows starts, for a text of at least one window."""
    key = rank[entropy_levels(np.frombuffer(text, np.uint8))] << 40 | np.arange(len(text) - WINDOW + 1)
    span = np.lib.stride_tricks.sliding_window_view(key, min(POPULAR, len(key)))
    return np.unique(span.min(1) & (1 << 40) - 1)


def features(texts: list[bytes], rank: np.ndarray, rare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of each selected window, in order. rare: rare_windows() where no window is popular."""
    data, offsets = joined(texts)
    size = np.diff(offsets)
    short = np.flatnonzero((size > 0) & (size < 2 * WINDOW - 1))
    chosen = []
    n = len(data)
    if n >= 2 * WINDOW - 1:
        key = rank[entropy_levels(data)] << 40 | np.arange(n - WINDOW + 1)
        d = 1
        while d < WINDOW:  # the least key of 64 windows, doubling the span
            key = np.minimum(key[:-d], key[d:])
            d *= 2
        best = key & (1 << 40) - 1
        ok = np.zeros(len(best), bool)
        for a, s in zip(offsets[:-1].tolist(), size.tolist()):
            if s >= 2 * WINDOW - 1:
                ok[a : a + s - 2 * WINDOW + 2] = True
        edge = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (ok[1:] != ok[:-1]), [True]]))
        run = np.diff(edge)
        keep = (run >= POPULAR) & ok[edge[:-1]]
        chosen.append(best[edge[:-1][keep]])
    starts = np.concatenate([*chosen, np.zeros(0, np.int64)])
    text = np.searchsorted(offsets, starts, side="right") - 1
    # texts with no popular window: rare windows, or their first bytes
    lone = np.setdiff1d(np.flatnonzero(size >= 2 * WINDOW - 1), text)
    at = offsets[lone]
    if rare:
        lone = np.concatenate([lone, short[size[short] >= WINDOW]])
        short = short[size[short] < WINDOW]
        found = [rare_windows(texts[i], rank) for i in lone]
        at = np.concatenate([np.zeros(0, np.int64), *(offsets[i] + f for i, f in zip(lone, found))])
        lone = np.repeat(lone, [len(f) for f in found])
    starts = np.concatenate([starts, at, offsets[short]])
    ends = np.concatenate([starts[: len(starts) - len(short)] + WINDOW, offsets[short] + size[short]])
    owner = np.concatenate([text, lone, short])
    order = np.lexsort((starts, owner))
    return owner[order], span_hashes(data, starts[order], ends[order])


def filters(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of Bloom filters of each text, (filters, 256) bytes."""
    out: list[np.ndarray] = []
    for i, j in groups(texts, 1_000_000):
        owner, h = features(texts[i:j], rank, rare=True)
        n = np.bincount(owner, minlength=j - i)
        first = np.concatenate([[0], np.cumsum(n)])
        chain = -(-n // PER_FILTER)
        base = np.concatenate([[0], np.cumsum(chain)])
        at = base[owner] + (np.arange(len(owner)) - first[owner]) // PER_FILTER
        bits = np.zeros((base[-1], BITS), bool)
        for k in range(HASHES):
            bits[at, ((h >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[a:b] for a, b in zip(base[:-1], base[1:])]
    return out


def encode(chain: np.ndarray) -> str:
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    best = np.zeros(len(a))
    of_b = np.bitwise_count(b).sum(1, dtype=np.int64)
    for i, x in enumerate(a):
        of_x = int(np.bitwise_count(x).sum(dtype=np.int64))
        both = np.bitwise_count(b & x).sum(1, dtype=np.int64)
        chance = of_x * of_b / BITS
        most = np.minimum(of_x, of_b) - chance
        best[i] = np.where(most > 0, (both - chance) / np.maximum(most, 1e-9), both == of_x).max()
    return float(np.clip(best, 0, 1).mean())


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (doc_id, text) in buckets of ascending id, each with the first row of the next bucket at its end (guest).

    No order over all rows is made in one task: bucket bounds are quantiles of the ids, and the rows of the first id
    of each bucket also go to the bucket before; those of the first bucket to the last one.
    """
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    steps = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(keyed.agg(F.percentile_approx("k", steps or [0.5])).first()[0] or []))
    top = 1
    while top <= len(bounds):
        top *= 2
    table = f"array({','.join(['-9223372036854775808L' if x == -(1 << 63) else f'{x}L' for x in bounds] + ['null'] * (top - len(bounds)))})" if bounds else "array(cast(null as bigint))"
    halves = [1 << i for i in range(top.bit_length() - 2, -1, -1)] or [1]
    search = f"aggregate(array({','.join(map(str, halves))}), 0, (at, s) -> if(coalesce(element_at(b, at + s) <= k, false), at + s, at))"
    placed = keyed.withColumn("b", F.expr(table.replace("-9223372036854775808L", "(-9223372036854775807L - 1L)"))).withColumn("bucket", F.expr(search)).drop("b")
    first = {r.bucket: r.k for r in placed.groupBy("bucket").agg(F.min("k").alias("k")).collect()}
    if not first:
        return placed.withColumn("guest", F.lit(False))
    order = sorted(first)
    before = dict(zip(order, [order[-1], *order[:-1]]))
    long_ = lambda x: "null" if x is None else "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"
    lists = [f"element_at(array({','.join(f(b) for b in range(len(bounds) + 1))}), bucket + 1)" for f in (lambda b: long_(first.get(b)), lambda b: str(before.get(b, -1)))]
    guest = F.expr(f"if(k = {lists[0]}, {lists[1]}, null)")
    both = F.when(guest.isNotNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.struct(guest.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))))
    return placed.withColumn("x", F.explode(both)).select("x.bucket", "x.guest", "k", "doc_id", "text")


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fit(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The frozen rarity of entropy levels, from all windows of all documents."""
    return rarity(level_counts(df.select(F.col(text_col).alias("text"))))


def fingerprints(df: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row of df."""

    def run(rows):
        for b in batches(rows):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(c) for c in filters(texts_of(b.column(1)), rank)], pa.string())], ["doc_id", "fingerprint"])

    return df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, fingerprint string")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text (the last quarter replaced by the next document's head) and the next one."""
    docs = df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"coalesce(`{text_col}`, '') as text")
    rank = fit(docs)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, 4 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "k", "text")

    def block(held):
        texts = [t.decode() for _, _, _, t in held]
        pairs = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
        edited = []
        for i in pairs:
            k = len(texts[i]) // 4
            edited.append((texts[i][: len(texts[i]) - k] + texts[i + 1][:k]).encode())
        own, other = filters([t for *_, t in held], rank), filters(edited, rank)
        out = [(held[i][2], len(texts[i]), hashlib.sha256(e).hexdigest(), encode(own[i]), encode(f), likeness(own[i], f), likeness(own[i], own[i + 1])) for i, e, f in zip(pairs, edited, other)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, _ROWS)], schema=_ROWS)

    def run(batches_):
        held, size = [], 0
        for b in batches(batches_):
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(3))):
                if row[1] and held and held[-1][1] and held[-1][0] == row[0]:
                    continue  # one guest is enough
                held.append(row)
                size += len(row[3])
                if size > 2_000_000:
                    yield block(held)
                    held, size = held[-1:], 0
        if held:
            yield block(held)

    return rows.select("bucket", "guest", "doc_id", "text").mapInArrow(run, ROWS)
