"""Phrase collocation mining by vertical positional inverted lists.

Texts are lower-cased (A-Z), split at `[.,;:!?\\n-\\r]` into pieces and those into words; everything is per language.

1. Tasks turn their texts into blocks of at most about ``block_words`` words, cut between pieces. A block numbers its
   words' places; two pieces have a free place between them, so what stands at adjacent places is one piece. It is kept as
   inverted lists: for each candidate, its places in ascending order.
2. The length of a candidate's list, summed over blocks, is its exact frequency. Each block sends its candidates and the
   lengths, packed, to the parts that count them, found by a hash; a part holds about as many candidates as a block, and
   a common one is as many numbers as blocks. It answers each block which candidates have ``least`` places and more over
   all blocks, and under what id. Candidates are compared whole, by bytes or by both ids, so frequencies are exact.
3. A block keeps the lists of its frequent phrases and extends them: the places of phrases are merge-joined with those one
   further on, whose phrases end in the adjacent word. A longer phrase is frequent only if the two that it overlaps are,
   so lists of other words are not looked at. The joined places are the lists of the next length's candidates, with
   (phrase id, word id) as key.
4. Words of phrases, cuts, scores, containment and ranks are joins and aggregates of the frequent phrases alone. The
   phrases of a language are ranked in two steps, first within salted parts of it.

Lists and counts are written between steps, so lost executors repeat one step. Nothing is collected or broadcast by this
module.

A null text is empty and has no phrase; a null language is `und`. Repeated rows count each, as documents. Ties in score and
frequency are ranked by the phrase's UTF-8 bytes. A very long text is cut into blocks between pieces; a piece is whole. An
empty table gives an empty table. Other columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut, drop_cut, give_back, mix64, release, texts_of

_BREAK = b"\xff"  # stands in no UTF-8 text
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")

_ID = 1 << 32
_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary()), ("places", pa.binary())])
_SENT_ROWS = "part long, block long, lang string, words binary, a binary, b binary, n binary, places binary"
_COUNTED = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("lang", pa.string()), ("keep", pa.binary()), ("ids", pa.binary()), ("id", pa.int64()), ("word", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64()), ("total", pa.int64())])
_COUNTED_ROWS = "block long, part long, lang string, keep binary, ids binary, id long, word binary, a long, b long, f long, total long"
_LISTS = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("lasts", pa.binary())])
_LIST_ROWS = "block long, places binary, sizes binary, ids binary, lasts binary"


def _shrink(x: np.ndarray) -> bytes:
    """Whole numbers by their differences, with their width and number in front."""
    kind = np.int32 if not len(x) or x.max() < 1 << 31 else np.int64
    x = x.astype(kind)
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + (pa.compress(np.diff(x, prepend=kind(0)).tobytes(), "zstd", asbytes=True) if len(x) else b"")


def _grow(data: bytes) -> np.ndarray:
    n, kind = int.from_bytes(data[1:9], "little"), np.int32 if data[0] == 4 else np.int64
    return np.cumsum(np.frombuffer(pa.decompress(data[9:], data[0] * n, "zstd", asbytes=True), kind), dtype=kind) if n else np.zeros(0, kind)


def _table(schema: pa.Schema, length: int, /, **columns) -> pa.Table:
    """Columns that are not given are null."""
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)


def pieces(text: bytes, some: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, with a break for each separator, in parts that end at a break if there is one."""
    text = text.translate(_FOLD)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= some else text.rfind(_BREAK, at, at + some) + 1 or text.find(_BREAK, at + some) + 1 or len(text)
        yield text[at:end].replace(_BREAK, b" \xff ").split(b" ")
        at = end


class _Block:
    """Words of several languages by place."""

    def __init__(self):
        self.ids: dict[str, defaultdict] = {}
        self.next = count(1)
        self.refs: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if lang not in self.ids:
            self.ids[lang] = defaultdict(self.next.__next__, {b"": -1, _BREAK: 0})
        refs = np.fromiter(map(self.ids[lang].__getitem__, words), np.int32, len(words))
        self.refs.append(refs[refs >= 0])
        self.size += len(self.refs[-1])

    def end(self) -> None:
        self.refs.append(np.zeros(1, np.int32))

    def rows(self, block: int, parts: int) -> pa.Table:
        """The words with the length of their lists, by part and language, and the lists in that order."""
        langs = sorted(self.ids)
        known = [[(w, i) for w, i in self.ids[x].items() if i > 0] for x in langs]
        words = [w for k in known for w, _ in k]
        number = np.array([i for k in known for _, i in k], np.int64)
        lang = np.repeat(np.arange(len(langs)), [len(k) for k in known])
        seeds = [zlib.crc32(x.encode()) for x in langs]
        part = np.array([zlib.crc32(w, s) for k, s in zip(known, seeds) for w, _ in k], np.int64) % parts
        order = np.lexsort((lang, part))
        refs = np.concatenate(self.refs)
        at = np.zeros(len(words) + 1, np.int64)
        at[number[order]] = np.arange(1, len(words) + 1)
        refs = at[refs]
        places, sizes = np.argsort(refs, kind="stable"), np.bincount(refs, minlength=len(words) + 1)
        places, sizes = places[sizes[0] :], sizes[1:]
        group = part[order] * len(langs) + lang[order]
        found, first = np.unique(group, return_index=True)
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(words)]))
        sent = _table(_SENT, len(found), part=found // max(len(langs), 1), block=np.full(len(found), block), lang=[langs[g % len(langs)] for g in found.tolist()], words=[pa.compress(b"\n".join(words[k] for k in order[i:j]), "zstd", asbytes=True) for i, j in spans], a=[sum(len(words[k]) + 1 for k in order[i:j]).to_bytes(8, "little") for i, j in spans], n=[_shrink(sizes[i:j]) for i, j in spans])
        lists = _table(_SENT, 1, part=[-1], block=[block], n=[_shrink(sizes)], places=[_shrink(places)])
        return pa.concat_tables([sent, lists])


def blocks(docs: DataFrame, block_words: int = 2_500_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The words of each block with the length of their lists, dealt to as many parts as docs has partitions, and the lists
    (part -1)."""
    chosen = docs.select(F.col(text_col), F.coalesce(lang_col, F.lit("und")))
    parts = max(1, chosen.rdd.getNumPartitions())

    def run(rows):
        block, at = _Block(), TaskContext.get().partitionId() << 14
        for b in batches(rows):
            for text, lang in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                for words in pieces(text):
                    block.add(lang, words)
                    if block.size >= block_words and words[-1] == b"":
                        yield from block.rows(at, parts).to_batches()
                        block, at = _Block(), at + 1
                block.end()
        if block.size:
            yield from block.rows(at, parts).to_batches()

    return chosen.mapInArrow(run, _SENT_ROWS)


def counted_words(sent: DataFrame, least: int) -> DataFrame:
    """For each block, part and language which words are frequent, and their ids; the frequent words with f; words in all."""

    def run(rows: pa.Table) -> pa.Table:
        part, out = rows.column("part")[0].as_py(), []
        rank = count()
        for lang in sorted(set(rows.column("lang").to_pylist())):
            some = rows.filter(pa.compute.equal(rows.column("lang"), lang))
            seen: defaultdict = defaultdict(count().__next__)
            refs, counts = [], []
            for data, size, n in zip(some.column("words").to_pylist(), some.column("a").to_pylist(), some.column("n").to_pylist()):
                words = pa.decompress(data, int.from_bytes(size, "little") - 1, "zstd", asbytes=True).split(b"\n")
                refs.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                counts.append(_grow(n).astype(np.int64))
            f = np.zeros(len(seen), np.int64)
            for r, n in zip(refs, counts):
                f[r] += n
            names = list(seen)
            chosen = sorted((k for k in np.flatnonzero(f >= least).tolist()), key=names.__getitem__)
            id_of = np.full(len(f), -1, np.int64)
            id_of[chosen] = [part * _ID + next(rank) for _ in chosen]
            k = len(chosen)
            out.append(_table(_COUNTED, k, lang=[lang] * k, id=id_of[chosen], word=[names[c] for c in chosen], f=f[chosen]))
            out.append(_table(_COUNTED, 1, lang=[lang], total=[int(f.sum())]))
            out.append(_told(some.column("block").to_pylist(), part, lang, [id_of[r] for r in refs]))
        give_back()
        return pa.concat_tables(out)

    return sent.groupBy("part").applyInArrow(run, _COUNTED_ROWS)


def _told(blocks: list[int], part: int, lang: str | None, ids: list[np.ndarray]) -> pa.Table:
    """For each block which of its candidates are frequent, and the ids of those."""
    k = len(blocks)
    return _table(_COUNTED, k, block=blocks, part=[part] * k, lang=[lang] * k, keep=[np.packbits(x >= 0).tobytes() for x in ids], ids=[_shrink(x[x >= 0]) for x in ids])


def _answers(told: pa.Table, sizes: list[int] | None = None) -> np.ndarray:
    """The ids of all candidates of a block in order of part and language, -1 for those that are not frequent."""
    told = told.sort_by([("part", "ascending"), ("lang", "ascending")])
    out = []
    for i, (keep, ids) in enumerate(zip(told.column("keep").to_pylist(), told.column("ids").to_pylist())):
        bits = np.unpackbits(np.frombuffer(keep, np.uint8), count=None if sizes is None else sizes[i]).astype(bool)
        own = np.full(len(bits), -1, np.int64)
        own[bits] = _grow(ids)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def word_lists(sent: DataFrame, counted: DataFrame) -> DataFrame:
    """The lists of frequent words of each block, with the ids of the words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left.filter(pa.compute.equal(left.column("part"), -1))
        if not lists.num_rows or not right.num_rows:
            return _LISTS.empty_table()
        groups = left.filter(pa.compute.not_equal(left.column("part"), -1)).sort_by([("part", "ascending"), ("lang", "ascending")])
        size = _grow(lists.column("n")[0].as_py())
        ids = _answers(right, [int.from_bytes(x[1:9], "little") for x in groups.column("n").to_pylist()])
        kept = ids >= 0
        places = _grow(lists.column("places")[0].as_py())[np.repeat(kept, size)]
        made = _shrink(ids[kept])
        return _table(_LISTS, 1, block=[lists.column("block")[0].as_py()], places=[_shrink(places)], sizes=[_shrink(size[kept])], ids=[made], lasts=[made])

    left = sent.select("block", "part", "lang", "n", "places")
    right = counted.where("block is not null").select("block", "part", "lang", "keep", "ids")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, _LIST_ROWS)


class _Joined:
    """The candidates one word longer of a block: each a pair of a frequent phrase and the word behind it.

    The lists of phrases are merge-joined with those one place further on, whose phrases end in the adjacent word.
    Candidates are ordered by the part that counts them."""

    def __init__(self, places: bytes, sizes: bytes, ids: bytes, lasts: bytes, parts: int):
        size, ids, lasts = _grow(sizes), _grow(ids).astype(np.int64), _grow(lasts).astype(np.int64)
        ref, place = np.repeat(np.arange(len(size), dtype=np.int32), size), _grow(places)
        order = np.argsort(place)
        ref, place = ref[order], place[order]
        at = np.flatnonzero(place[1:] == place[:-1] + 1)
        words, word = np.unique(lasts[ref[at + 1]], return_inverse=True)
        pair, of, n = np.unique(ref[at].astype(np.int64) * max(len(words), 1) + word, return_inverse=True, return_counts=True)
        a, b = (ids[pair // len(words)], words[pair % len(words)]) if len(pair) else (pair, pair)
        part = (mix64(mix64(a) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.part, self.a, self.b, self.n = part[order], a[order], b[order], n[order]
        self.of, self.place = number[of], place[at]
        self.parts, first = np.unique(self.part, return_index=True)
        self.spans = list(zip(first.tolist(), [*first[1:].tolist(), len(pair)]))


def _sent_phrases(lists: DataFrame, parts: int) -> DataFrame:
    """The candidates one word longer of each block with the length of their lists, dealt to parts by a hash of both ids."""

    def run(rows):
        for b in batches(rows):
            for block, *state in zip(*(c.to_pylist() for c in b.columns)):
                j = _Joined(*state, parts)
                k = len(j.parts)
                pack = lambda x: [_shrink(x[i:e]) for i, e in j.spans]  # noqa: E731, B023
                yield from _table(_SENT, k, part=j.parts, block=np.full(k, block), a=pack(j.a), b=pack(j.b), n=pack(j.n)).to_batches()

    return lists.select(*_LISTS.names).mapInArrow(run, _SENT_ROWS)


def counted_phrases(sent: DataFrame, least: int) -> DataFrame:
    """For each block and part which candidates are frequent, and their ids; the frequent phrases with f."""

    def run(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        a, b, n = ([_grow(x).astype(np.int64) for x in rows.column(c).to_pylist()] for c in "abn")
        cuts = np.cumsum([len(x) for x in a])[:-1]
        first, second = np.concatenate(a), np.concatenate(b)
        heads, head = np.unique(first, return_inverse=True)
        tails, tail = np.unique(second, return_inverse=True)
        pair, at, of = np.unique(head * len(tails) + tail, return_index=True, return_inverse=True)
        f = np.zeros(len(pair), np.int64)
        np.add.at(f, of, np.concatenate(n))
        chosen = np.flatnonzero(f >= least)
        id_of = np.full(len(pair), -1, np.int64)
        id_of[chosen] = part * _ID + np.arange(len(chosen))
        found = _table(_COUNTED, len(chosen), id=id_of[chosen], a=first[at[chosen]], b=second[at[chosen]], f=f[chosen])
        told = _told(rows.column("block").to_pylist(), part, None, np.split(id_of[of], cuts))
        give_back()
        return pa.concat_tables([found, told])

    return sent.groupBy("part").applyInArrow(run, _COUNTED_ROWS)


def phrase_lists(lists: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """The lists of frequent phrases one word longer."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _LISTS.empty_table()
        block, *state = (left.column(c)[0].as_py() for c in _LISTS.names)
        j = _Joined(*state, parts)
        ids = _answers(right, [e - i for i, e in j.spans])
        kept = ids >= 0
        number, own = np.cumsum(kept) - 1, kept[j.of]
        of = number[j.of[own]]
        out = _table(_LISTS, 1, block=[block], places=[_shrink(j.place[own][np.argsort(of, kind="stable")])], sizes=[_shrink(j.n[kept])], ids=[_shrink(ids[kept])], lasts=[_shrink(j.b[kept])])
        give_back()
        return out

    right = counted.where("block is not null").select("block", "part", "lang", "keep", "ids")
    return lists.select(*_LISTS.names).groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, _LIST_ROWS)


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, block_words: int = 2_500_000) -> tuple[list[DataFrame], DataFrame]:
    """(written tables of the frequent phrases of 1, 2, ... words: lang, words (ids), text, f, id; n of each language)."""
    spark = docs.sparkSession
    sent = cut(blocks(docs, block_words))
    parts = max(1, sent.where("part = -1").count())  # one a block: a part counts about as much as a block holds
    counted = cut(counted_words(sent.where("part >= 0").select("part", "block", "lang", "words", "a", "n"), least))
    totals = cut(counted.where("total is not null").groupBy("lang").agg(F.sum("total").alias("n")))
    levels = [cut(counted.where("word is not null").select("lang", F.array("id").alias("words"), F.col("word").alias("text"), "f", "id"))]
    word = levels[0].select(F.col("id").alias("b"), F.col("text").alias("word"))
    lists = cut(word_lists(sent, counted))
    drop_cut(sent, counted)
    release(spark)
    for k in range(2, longest + 1):
        counted = cut(counted_phrases(_sent_phrases(lists, parts).select("part", "block", "a", "b", "n"), least))
        before = levels[-1].select(F.col("id").alias("a"), "lang", "words", "text")
        joined = counted.where("block is null").select("a", "b", "f", "id").join(before, "a").join(word, "b")
        levels.append(cut(joined.select("lang", F.array_append("words", F.col("b")).alias("words"), F.concat("text", F.lit(b" "), "word").alias("text"), "f", "id")))
        release(spark)
        last = lists
        if k < longest:
            lists = cut(phrase_lists(last, counted, parts))
        drop_cut(last, counted)
        release(spark)
    return levels, totals


def scored(every: DataFrame, longest: int = 4) -> DataFrame:
    """Phrases of 2 words and more with their lowest-scoring cut, without those that a longer one accounts for."""
    f, size = every.select("words", "f"), F.size("words")
    # a longer phrase has one of one word more inside it that holds the same phrase and is as frequent at least
    ends = every.where(size > 2).select(F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("f").alias("longer"))
    longer = ends.groupBy("words").agg(F.max("longer").alias("longer"))
    exact = lambda c, digits=20: F.col(c).cast(f"decimal({digits},0)")
    mine = every.where(size > 1).join(longer, "words", "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(3,0)") * exact("longer") < F.lit(80).cast("decimal(2,0)") * exact("f")))
    cuts = mine.select("lang", "text", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.lit(longest))})
    l, r = f.select(F.col("words").alias("left"), F.col("f").alias("l")), f.select(F.col("words").alias("right"), F.col("f").alias("r"))
    both = sides.join(l, "left").join(r, "right").withColumns({"x": F.lit(2_000_000).cast("decimal(7,0)") * exact("a", 19), "y": (exact("l") + exact("r"))})
    lowest = both.groupBy("words").agg(F.first("lang").alias("lang"), F.first("text").alias("text"), F.first("a").alias("a"), F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("c"))
    return lowest.select("lang", "text", "a", "c.l", "c.r", "c.score")


def best(docs: DataFrame, most: int = 2000, least: int = 30, longest: int = 4, block_words: int = 2_500_000, parts: int = 64) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    levels, totals = phrases(docs, least, longest, block_words)
    rows = scored(reduce(DataFrame.unionByName, levels), longest).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    order = [F.desc("score"), F.desc("a"), F.asc("text")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    out = cut(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").cast("string").alias("phrase"), "a", "l", "r", "n", "score"))
    drop_cut(*levels, totals)
    return out


def oracle_sql() -> str:
    """The same in DuckDB: all phrases of up to four words counted from the words of each piece."""
    return r"""
with p as (
  select row_number() over () d, coalesce(lang, 'und') lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select row_number() over () p, lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
g as (select lang, w[i:i + k - 1] s from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, range(1, 5) r(k) where len(w) >= k)),
f as materialized (select lang, s, len(s) m, count(*)::hugeint f from g group by lang, s),
n as (select lang, sum(f)::bigint n from f where m = 1 group by lang),
c as materialized (select * from f where f >= 30 and m > 1),
up as (select lang, s, max(f) f from (select lang, s[:-2] s, f from c where m > 2 union all select lang, s[2:] s, f from c where m > 2) group by all),
kept as (select c.* from c left join up on up.lang = c.lang and up.s = c.s where up.f is null or 100 * up.f < 80 * c.f),
cuts as (
  select kept.lang, kept.s, kept.f a, k, x.f l, y.f r, (2000000::hugeint * kept.f) // (x.f + y.f) score
  from kept, range(1, 4) q(k), f x, f y where k < kept.m and x.lang = kept.lang and x.s = kept.s[:k] and y.lang = kept.lang and y.s = kept.s[k + 1:]),
low as (select * from cuts qualify row_number() over (partition by lang, s order by score, k) = 1),
t as (select *, array_to_string(s, ' ') phrase from low),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) "rank" from t)
select ranked.lang, "rank"::bigint "rank", phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score from ranked join n on n.lang = ranked.lang where "rank" <= 2000"""
