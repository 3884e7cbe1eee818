"""N-gram Jaccard self-join by token-combination prefixes.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence as one). Two documents link
when their sets' Jaccard similarity is at least ``percent`` / 100. The result has the size of each set and the smallest
doc_id that links reach.

Tokens (shingle hashes) fall in two classes by a sketch of counts over all documents: rare ones come first in the
global order, frequent ones last. Of two similar sets

* if the ordinary prefix of one is all rare, both prefixes share a rare token: single rare tokens are indexed;
* else both are made of frequent tokens for the most part. Their prefixes are extended to the whole set, and
  combinations of about ``k`` tokens are indexed, those of one segment of the hash range. Sets that differ in d tokens
  differ in at most d segments, and a set fills more segments than d, so one combination at least is shared; of its
  combinations, ordered by the number of sets that have them, the first d + 1 are enough. (All k-subsets of an
  extended prefix would do as well, but their number is a power of its length.)

Any rule for classes gives the same links, so errors of the sketch cost time only. Copies of one set are one vertex.
Candidates of a key are the pairs of its first vertex with the others, and a round verifies for each vertex the one
with which it shares most keys: no more pairs than vertices. When links have made components, a key whose vertices are
in one component is done. Rounds go on, with other first vertices, while the pairs across components that are left
outnumber the vertices, ``rounds`` times at most; then all that are left are compared, those of large keys in blocks. So no key makes all pairs of a
group of copies, and no link between components is lost. Verification compares whole sets; a histogram of each set,
which bounds the overlap from above, precedes it.

Nulls: a null text has no shingles and no link; a row with a null id gets its set's size and a null component. A
component is one of ids: rows that repeat an id have each the size of their own set, and links of any of them are links
of the id, so that unlike texts of one id are in one component. An empty table gives an empty table. A very long text
is hashed by itself, whole. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, drop_cut, joined, mix64, release, span_hashes, texts_of, tune
from loomlake.llm.token_fst import groups

WORDS = 5
CELL_BITS, SLICE_BITS = 22, 16
NODE_BITS = 24
BUCKETS = 512
#: Sets of a task whose copies are known, at most.
NOTED = 200_000
#: Keys of more vertices are compared in blocks; keys that a vertex brings along there, and what stands for none.
FEW = 16
LOWEST, _LAST = 16, (1 << 63) - 1
U = np.uint64
_PLACE = mix64(np.arange(1, 2 * WORDS + 1, dtype=U))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; some texts at a time, as hashing takes 50 bytes for each of theirs."""
    return [s for i, j in groups(texts, 500_000) for s in _sets(texts[i:j])]


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data, offsets = joined([t + b" " for t in texts])
    data = _LOWER[data]
    inside = np.concatenate([[False], ~_SPACE[data]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    word = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    n = len(word)
    rolled = np.zeros(n, U)
    for j in range(WORDS):
        rolled[: max(n - j, 0)] += word[j:] * _PLACE[j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            h = np.sort(rolled[a : b - WORDS + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            out.append(mix64((word[a:b] * _PLACE[WORDS : WORDS + b - a]).sum(keepdims=True) + _PLACE[b - a]))
        else:
            out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _classes_of_size() -> list[int]:
    """Lower bounds of size classes: sets of linked documents are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * 5 // 4) + 1)
    return out


_SIZES = np.array(_classes_of_size())


def combination_keys(s: np.ndarray, k: int = 4, percent: int = 80) -> np.ndarray:
    """Keys of the token combinations of a set, under the schemes of its size class and the next."""
    return np.concatenate([keys for _, keys, _ in combinations(s, k, percent)])


def combinations(s: np.ndarray, k: int, percent: int) -> list[tuple[int, np.ndarray, int]]:
    """(scheme, keys, keys enough) of a set: a linked set has one at least of the rarest that are enough among its own."""
    n = len(s)
    most = n * (100 - percent) // percent  # tokens that one of two linked sets has alone, together
    cls = int(np.searchsorted(_SIZES, n, side="right")) - 1
    out = []
    for j in (cls, cls + 1):
        top = int(_SIZES[j + 1]) - 1
        salt = mix64(np.array([j + 77], U))[0]
        h = mix64(s ^ salt)
        # segments twice as many as differences can be; small sets: every token for itself
        segments = 1 << 32 if top <= 32 else -(-top * 2 // k)
        seg = (h >> U(16)) % U(segments)
        order = np.argsort(seg, kind="stable")
        seg, h = seg[order], h[order]
        at = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        sums = np.add.reduceat(mix64(h + salt), at)
        keys, enough = mix64(sums + mix64(seg[at] ^ mix64(np.array([j], U))[0])), most + 1
        if len(at) <= most:  # too few filled segments to be sure of a shared one: meet all such sets
            keys = np.concatenate([keys, mix64(np.array([j], U))])
            enough = len(keys)
        out.append((j + 1, keys, enough))
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (doc_id, n, lo, hi) of each document; (slice, cells, total) of each task's counts."""

    def run(rows):
        cells, total, held, seen = np.zeros(1 << CELL_BITS, np.uint32), 0, [], set()

        def pour():
            if held:
                cells[:] += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << CELL_BITS).astype(np.uint32)
                held.clear()

        for b in batches(rows):
            n, lo, hi, waiting = [], [], [], 0
            for s in shingle_sets(texts_of(b.column(1))):
                sig = signature(s)
                n.append(len(s))
                lo.append(sig[0])
                hi.append(sig[1])
                if sig[0] not in seen:
                    if len(seen) < NOTED:  # copies of what is not noted are counted again, as of other texts
                        seen.add(sig[0])
                    held.append(s & U((1 << CELL_BITS) - 1))
                    total += len(s)
            if sum(map(len, held)) > 1_000_000:
                pour()
            k = len(n)
            yield _batch(docs_schema, [b.column(0), n, lo, hi, pa.nulls(k), pa.nulls(k), pa.nulls(k)])
        pour()
        if total:
            parts = cells.reshape(-1, 1 << SLICE_BITS)
            for i in range(0, len(parts), 8):
                m = [x.tobytes() for x in parts[i : i + 8]]
                k = len(m)
                yield _batch(docs_schema, [pa.nulls(k)] * 4 + [list(range(i, i + k)), m, [total if i + j == 0 else 0 for j in range(k)]])

    return docs.mapInArrow(run, "doc_id long, n long, lo long, hi long, slice int, cells binary, total long")


docs_schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("slice", pa.int32()), ("cells", pa.binary()), ("total", pa.int64())])


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _gather_bits(df: DataFrame, make, bits: int) -> np.ndarray:
    """df (slice, ...) -> packed bits of all slices; make(rows) gives {slice: bool array}. 2^bits bits in all."""
    got = df.repartition("slice").mapInArrow(make, "slice int, bits binary").collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    width = (1 << SLICE_BITS) // 8
    for r in got:
        out[r.slice * width : (r.slice + 1) * width] |= np.frombuffer(r.bits, np.uint8)
    return out


def _bits_batch(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in found.values()], pa.binary())], ["slice", "bits"])


def frequent_cells(counts: DataFrame) -> np.ndarray:
    """Packed bits of the cells whose count stands out. 512 KB at any size of the input."""
    counts = counts.where("slice is not null")
    mean = (counts.agg(F.sum("total")).first()[0] or 0) / (1 << CELL_BITS)
    least = mean + max(24, 8 * mean**0.5)

    def run(rows):
        sums: dict[int, np.ndarray] = {}
        for b in batches(rows):
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, np.uint32)
                sums[i] = sums[i] + c if i in sums else c.astype(np.uint64)
        if sums:
            yield _bits_batch({i: v > least for i, v in sums.items()})

    return _gather_bits(counts.select("slice", "cells"), run, CELL_BITS)


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def index_keys(docs: DataFrame, frequent, percent: int, k: int) -> DataFrame:
    """(key, lo, n, scheme, spare): the index entries of each set; copies within a task once.

    scheme: 0 for single tokens, which all count; spare: of a scheme's keys, how many the set can do without."""
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("scheme", pa.int32()), ("spare", pa.int32())])

    def run(rows):
        bits, seen = frequent.value, set()
        for b in batches(rows):
            keys, about = [], []
            for s in shingle_sets(texts_of(b.column(1))):
                n = len(s)
                if not n or (sig := signature(s)) in seen:
                    continue
                if len(seen) < NOTED:  # what is not noted goes through twice, to no harm
                    seen.add(sig)
                rare = s[~has(bits, (s & U((1 << CELL_BITS) - 1)).astype(np.int64))]
                p = n - -(-percent * n // 100) + 1
                own = [(0, rare[:p], p)] if len(rare) >= p else [(0, rare, n), *combinations(s, k, percent)]
                for scheme, x, enough in own:
                    keys.append(x)
                    about.append((len(x), sig[0], n, scheme, max(len(x) - enough, 0)))
            if keys:
                sizes, *rest = (np.array(x, np.int64) for x in zip(*about))
                columns = [np.concatenate(keys).view(np.int64), *(np.repeat(x, sizes) for x in rest)]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(columns, schema)], schema=schema)

    return docs.mapInArrow(run, "key long, lo long, n int, scheme int, spare int")


def prefixes(keys: DataFrame) -> DataFrame:
    """(key, lo, n): of each set's keys that another set has too, those of its extended prefix, rare keys first.

    Linked sets share more keys of a scheme than one: all but as many as tokens differ. So the most widespread keys of
    each set, ``spare`` of them, can go, and two linked sets still have one in common; keys that no other set has are
    the first of the prefix and go too."""
    shared = keys.repartition("key").distinct().withColumn("sets", F.count("*").over(Window.partitionBy("key"))).where("sets > 1")
    last = Window.partitionBy("lo", "scheme").orderBy(F.desc("sets"), F.desc("key"))
    return shared.withColumn("place", F.row_number().over(last)).where("place > spare").select("key", "lo", "n")


def _node_at(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(U)) & U((1 << NODE_BITS) - 1)).astype(np.int64)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bit filter of vertex ids: 2 MB at any size of the input. False hits cost time only."""

    def place(rows):
        for b in batches(rows):
            at = np.unique(_node_at(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((at >> SLICE_BITS).astype(np.int32)), pa.array(at)], ["slice", "at"])

    def run(rows):
        found: dict[int, np.ndarray] = {}
        for b in batches(rows):
            at = b.column(1).to_numpy()
            for i in np.unique(at >> SLICE_BITS).tolist():
                found.setdefault(i, np.zeros(1 << SLICE_BITS, bool))[at[at >> SLICE_BITS == i] & (1 << SLICE_BITS) - 1] = True
        if found:
            yield _bits_batch(found)

    return _gather_bits(nodes.mapInArrow(place, "slice int, at long").distinct(), run, NODE_BITS)


def vertices(docs: DataFrame, needed) -> DataFrame:
    """(rep, n, hist): size and counts of tokens by bucket of the sets of needed vertices."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int32()), ("hist", pa.binary())])

    def run(rows):
        for b in batches(rows):
            b = b.filter(pa.array(has(needed.value, _node_at(b.column(0).to_numpy()))))
            out = []
            for rep, s in zip(b.column(0).to_pylist(), shingle_sets(texts_of(b.column(1)))):
                hist = np.minimum(np.bincount((s >> U(55)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)
                out.append((rep, len(s), hist.tobytes()))
            if out:
                yield _batch(schema, [list(c) for c in zip(*out)])

    return docs.mapInArrow(run, "rep long, n int, hist binary")


def members(docs: DataFrame, needed) -> DataFrame:
    """(rep, members): the sets of needed vertices, made from their texts when they are to be compared."""

    def run(rows):
        for b in batches(rows):
            b = b.filter(pa.array(has(needed.value, _node_at(b.column(0).to_numpy()))))
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [s.tobytes() for s in shingle_sets(texts_of(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["rep", "members"])

    return docs.mapInArrow(run, "rep long, members binary")


_PAIRS = "a long, b long"


def _sides(df: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    for side in "ab":
        df = df.join(sets.select(F.col("rep").alias(side), *[F.col(c).alias(c + side) for c in cols]), side)
    return df.select("a", "b", *[c + side for c in cols for side in "ab"])


def _hists(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS)


def _most(na, nb, ha, hb) -> np.ndarray:
    """Upper bounds of overlaps from sizes and histograms; these have clipped counts, which bound nothing."""
    full = ((ha == 255) & (hb == 255)).any(-1)
    return np.where(full, np.minimum(na, nb), np.minimum(ha, hb).sum(-1, dtype=np.int64))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the candidate vertices (a, b), those that can link by their histograms."""

    def run(rows):
        for x in batches(rows):
            na, nb = (x.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            most = _most(na, nb, _hists(x.column(4)), _hists(x.column(5)))
            yield x.select(["a", "b"]).filter(pa.array(100 * most >= percent * (na + nb - most)))

    return _sides(pairs, nodes, "n", "hist").mapInArrow(run, _PAIRS)


def likely_in_blocks(open_: DataFrame, nodes: DataFrame, percent: int, size: int = 1024) -> DataFrame:
    """(a, b) across components that share a key and can link by their histograms, some more than once.

    A key's vertices are dealt to blocks of about ``size``; one task compares two blocks and gives what is left only. A
    pair that shares several keys is given by the first of them: each vertex brings its ``LOWEST`` first keys, and a pair
    with an earlier key in common among these is left to that key. Its very first key always gives it."""
    rows = open_.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("key")) / size).cast("int"))
    # a vertex meets its histogram once, with the list of its keys, which is as long as its own set at most
    rows = rows.groupBy("rep", "c").agg(F.collect_list(F.struct("key", "blocks", "n")).alias("entries")).join(nodes.select("rep", "hist"), "rep")
    rows = rows.withColumn("low", F.slice(F.concat(F.sort_array("entries.key"), F.array_repeat(F.lit(_LAST), LOWEST)), 1, LOWEST))
    rows = rows.selectExpr("rep", "c", "hist", "low", "inline(entries)").withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).selectExpr("key", "least(own, other) as i", "greatest(own, other) as j", "own", "rep", "c", "n", "hist", "low")

    def run(t: pa.Table) -> pa.Table:
        own, rep, c, n = (t.column(x).to_numpy().astype(np.int64) for x in ("own", "rep", "c", "n"))
        hist, i, j = _hists(t.column("hist")), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        low, key = t.column("low").combine_chunks().flatten().to_numpy().reshape(-1, LOWEST), t.column("key")[0].as_py()
        found = []
        for at in range(0, len(left), 32):
            x = left[at : at + 32, None]
            most = _most(n[x], n[right], hist[x], hist[right])
            keep = (100 * most >= percent * (n[x] + n[right] - most)) & (c[x] != c[right])
            u, v = np.nonzero(keep)
            for k in range(0, len(u), 4096):
                a, b = low[left[at + u[k : k + 4096]]], low[right[v[k : k + 4096]]]
                before = ((a[:, :, None] == b[:, None, :]) & (a < key)[:, :, None]).any((1, 2))
                keep[u[k : k + 4096][before], v[k : k + 4096][before]] = False
            u, v = np.nonzero(keep)
            found.append(np.stack([rep[left[at + u]], rep[right[v]]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": both.min(0), "b": both.max(0)})

    return rows.groupBy("key", "i", "j").applyInArrow(run, _PAIRS)


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of the likely vertices (a, b), a table, those that link."""

    def exact(rows):
        for x in batches(rows):
            keep = []
            for i in range(x.num_rows):
                sa, sb = (np.frombuffer(x.column(c)[i].as_buffer(), U) for c in (2, 3))
                both = np.sort(np.concatenate([sa, sb]))
                o = int((both[1:] == both[:-1]).sum())
                keep.append(100 * o >= percent * (len(sa) + len(sb) - o))
            yield x.select(["a", "b"]).filter(pa.array(keep))

    spark = pairs.sparkSession
    used = spark.sparkContext.broadcast(node_filter(pairs.select("a").union(pairs.select("b"))))
    # pairs of very long sets are megabytes each: few of them in a batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    try:
        return cut(_sides(pairs, members(docs, used), "members").mapInArrow(exact, _PAIRS))
    finally:
        tune(spark)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, c): the smallest vertex that each linked vertex reaches, itself left out if it is that one.

    Stars of large and small neighbours in turn; each round is a table in the shared folder.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("c"))
        before, last = state, now
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        now = cut(small)
        drop_cut(last)


_ENDS = ("least(rep, rep2) as a", "greatest(rep, rep2) as b")


def open_pairs(open_: DataFrame) -> int:
    """The number of pairs of vertices that share a key and are in different components, each key's counted."""
    parts = open_.groupBy("key", "c").agg(F.count("*").cast("double").alias("x"))
    keys = parts.groupBy("key").agg(F.sum("x").alias("all"), F.sum(F.expr("x * x")).alias("own"))
    return int(keys.agg(F.sum(F.expr("(all * all - own) / 2"))).first()[0] or 0)


def join_components(df: DataFrame, percent: int = 80, k: int = 4, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of df. rounds: star rounds, at most, before all pairs across components."""
    spark = df.sparkSession
    docs = df.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    base = cut(sketch(docs))
    frequent = spark.sparkContext.broadcast(frequent_cells(base))
    rows = base.where("slice is null").select("doc_id", "n", "lo", "hi")
    known = docs.where("doc_id is not null")
    over = Window.partitionBy("key")
    keys = cut(
        prefixes(index_keys(known, frequent, percent, k))
        .withColumns({"least": F.min("lo").over(over), "most": F.max("lo").over(over)})
        .where("least <> most")
        .select("key", "lo", "n")
    )
    release(spark)
    vertex = rows.where("n > 0").groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"))
    open_ = cut(keys.join(vertex.select("lo", "rep"), "lo").where("rep is not null").select("key", "rep", "n").distinct().withColumn("c", F.col("rep")))
    drop_cut(keys)
    needed = spark.sparkContext.broadcast(node_filter(open_.select("rep").distinct()))
    nodes = cut(vertices(known, needed))
    release(spark)
    links = cut(spark.range(0).selectExpr("id as a", "id as b"))
    tested = links
    fits = f"least(n, n2) * 100 >= greatest(n, n2) * {percent}"
    enough = 2 * nodes.count()
    for r in range(rounds + 1):
        last_round = r == rounds or (r > 0 and open_pairs(open_) <= enough)
        if last_round:  # all that are left, across components only
            sized = open_.withColumn("sets", F.count("*").over(over))
            few, many = sized.where(f"sets <= {FEW}").drop("sets"), sized.where(f"sets > {FEW}").drop("sets")
            other = few.select("key", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
            pairs = few.join(other, "key").where(f"c < c2 and {fits}").selectExpr(*_ENDS).distinct().join(tested, ["a", "b"], "left_anti")
            pairs = likely(pairs, nodes, percent).union(likely_in_blocks(many, nodes, percent).distinct().join(tested, ["a", "b"], "left_anti")).distinct()
        else:  # of each vertex the pair with most shared keys
            mixed = F.struct((F.xxhash64("rep", F.lit(r)) if r else F.col("rep")).alias("order"), F.col("rep").alias("rep"), F.col("n").alias("n"), F.col("c").alias("c"))
            star = open_.withColumn("m", F.min(mixed).over(over)).select("c", "rep", "n", F.col("m.rep").alias("rep2"), F.col("m.n").alias("n2"), F.col("m.c").alias("c2"))
            pairs = star.where(f"c <> c2 and {fits}").groupBy("rep", "rep2").agg(F.count("*").alias("shared")).selectExpr("*", *_ENDS)
            pairs = pairs.join(tested, ["a", "b"], "left_anti") if r else pairs
            pairs = cut(pairs.groupBy("rep").agg(F.max(F.struct("shared", "rep2")).alias("m")).select("rep", "m.rep2").selectExpr(*_ENDS).distinct())
        found = verify(cut(pairs if last_round else likely(pairs, nodes, percent)), known, percent)
        links = links.union(found)
        release(spark)
        comps = components(links)
        if last_round:
            break
        tested = tested.union(pairs)
        last, inner = open_, open_.drop("c").join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c"))
        open_ = cut(inner.withColumns({"lc": F.min("c").over(over), "mc": F.max("c").over(over)}).where("lc <> mc").drop("lc", "mc"))
        drop_cut(last)
        if open_.isEmpty():
            break
    named = vertex.join(comps.select(F.col("v").alias("rep"), "c"), "rep", "left").select("lo", "hi", F.coalesce("c", "rep").alias("c"))
    full = rows.where("n > 0").join(named, ["lo", "hi"], "left")
    lone = rows.where("n = 0").withColumn("c", F.col("doc_id"))
    return full.unionByName(lone).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))


def first_of_each(df: DataFrame, **options) -> DataFrame:
    """The rows of df whose document is the smallest of its component. Rows with a null id stay."""
    key = options.get("id_col", "doc_id")
    keep = join_components(df, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    id_ = F.col(f"`{key}`")
    names = [f"_kept{i}" for i in range(len(df.columns))]  # no name of df's can clash with the key's
    rows, at = df.toDF(*names), names[df.columns.index(key)]
    return rows.join(keep, F.col(at).cast("long") == F.col("_first"), "left_semi").toDF(*df.columns).unionByName(df.where(id_.isNull()))
