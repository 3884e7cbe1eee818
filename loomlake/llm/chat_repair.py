"""Conversation structure repair: the cheapest edits that make the roles of a conversation `(s?(ua)+)?`.

A forward Viterbi pass runs over the rows of each conversation. Its four states are what of the grammar has been read:
nothing, the system turn, a user turn, an assistant turn. A state carries the least (cost, audit), the audit being the
initials of the edits so far: Keep (0), Rerole to user or assistant (2), Delete (3, the only edit of a blank or repeated
row), Insert an empty user or assistant turn (2); an undeleted truncated row adds 1. Behind each row the layer is closed by
inserts: a user from any state but the user's, then an assistant from the user's; more inserts in a row never pay.

Of two audits that cost the same in one state neither begins with the other, as what an audit costs follows from its rows
and letters; so the lesser one stays the lesser whatever is appended, and the pass needs no more than one a state. The
audit also fixes the repaired roles: a kept system turn may open them, and user and assistant take turns from there.

The pass sees no text: Spark makes of each row a digest, the initial of its role and its faults. Rows of a conversation
are sorted by (turn, digest) and streamed, so memory is that of one audit, a letter a row (what all states agree on is put
aside). First occurrences of a digest are found by an aggregate that combines before its shuffle, and come as marker rows
in front of theirs, so no set of what was seen is kept. A second stream goes through the texts in the same order, the plan
in front of each conversation, and applies it. One conversation is one task in both streams, as its order asks for: one
that holds most rows is slow, and needs no more memory than another.

A null role or text is one space, so such a text is blank. Null turns come first. Rows that tie in turn stand by the
digest of role and text, so results do not depend on how rows come; repeated rows are repeated turns. Rows with a null
conversation id are one conversation. Very long texts are one turn, whole; an empty table gives an empty table. Other
columns, of whatever name, are not looked at.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import batches, cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
#: States: nothing read, system, user, assistant.
_FROM = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
_ANY = _FROM["u"] + _FROM["a"]

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
TURNS = "conv_id long, place long, role string, text string, edit string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


class Viterbi:
    """The pass over one conversation."""

    def __init__(self):
        self.states: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.settled: list[str] = []
        self._close()

    def _close(self) -> None:
        v = self.states
        for p, q in _ANY:  # users first: the assistant's state takes from what they have become
            if v[p] is not None and (v[q] is None or (v[p][0] + INSERT, v[p][1] + "I") < v[q]):
                v[q] = (v[p][0] + INSERT, v[p][1] + "I")

    def row(self, initial: str, gone: bool, truncated: bool) -> None:
        """One row: ``gone`` has to be deleted."""
        old = self.states
        new = [None if v is None else (v[0] + DELETE, v[1] + "D") for v in old]
        if not gone:
            extra = TRUNCATED if truncated else 0
            for ways, cost, letter in ((_FROM.get(initial, ()), KEEP, "K"), (_ANY, REROLE, "R")):
                for p, q in ways:
                    if old[p] is not None:
                        made = (old[p][0] + cost + extra, old[p][1] + letter)
                        if new[q] is None or made < new[q]:
                            new[q] = made
        self.states = new
        self._close()
        if len(self.states[2][1]) > 64:
            self._settle()

    def _settle(self) -> None:
        """Put aside what the audits of all states begin with. States that can no longer win go first: whatever may follow
        nothing or a system turn may follow an assistant turn too, an opening system turn being deleted there."""
        v = self.states
        for q, spare in ((0, DELETE), (1, 0)):
            if v[q] is not None and v[q][0] > v[3][0] + spare:
                v[q] = None
        same = os.path.commonprefix([x[1] for x in v if x is not None])
        if same:
            self.settled.append(same)
            self.states = [None if x is None else (x[0], x[1][len(same) :]) for x in v]

    def best(self) -> tuple[int, str]:
        """The least (cost, audit) of the states in which a conversation may end."""
        cost, audit = min(v for v in (self.states[0], self.states[3]) if v is not None)
        return cost, "".join(self.settled) + audit


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with nulls made one space, the digest of role and text, and what the pass needs."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return out.withColumns({"digest": digest, "last": F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5)), F.lit(1))})


def _seen(rows: DataFrame) -> DataFrame:
    """The first place of each text of a conversation."""
    place = F.struct(F.col("turn").isNotNull().alias("n"), F.col("turn").alias("turn"))
    return rows.groupBy("conv_id", "digest").agg(F.min(place).alias("p")).select("conv_id", F.col("p.turn").alias("turn"), "digest")


def plans(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> for each conversation its faults, the cheapest cost and the audit of its edits."""
    light = faults(rows).select("conv_id", "turn", "digest", F.lit(1).alias("kind"), F.left("role", F.lit(1)).alias("initial"), "last")
    marked = light.unionByName(_seen(light).select("conv_id", "turn", "digest", F.lit(0).alias("kind"), F.lit("").alias("initial"), F.lit("").alias("last")))
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "kind")

    def run(parts):
        made: list[tuple] = []
        conv, state = None, None
        for b in batches(parts):
            for c, turn, digest, kind, initial, last in zip(*(x.to_pylist() for x in b.columns)):
                if state is None or c != conv:
                    if state is not None:
                        made.append((conv, *state.report()))
                    conv, state = c, _Pass()
                state.take(turn, digest, kind, initial, last)
            if len(made) > 4096:
                yield _batch(made, _REPORT)
                made = []
        if state is not None:
            made.append((conv, *state.report()))
        if made:
            yield _batch(made, _REPORT)

    return ordered.mapInArrow(run, REPORT)


class _Pass:
    """What is counted along one conversation."""

    def __init__(self):
        self.viterbi, self.before, self.fresh = Viterbi(), None, None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def take(self, turn, digest, kind: int, initial: str, last: str) -> None:
        if kind == 0:
            self.fresh = (turn, digest)
            return
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        blank, first = last == "", self.fresh == (turn, digest)
        self.fresh = None
        cut = not blank and first and last not in ".!?"
        self.blank += blank
        self.duplicate += not blank and not first
        self.truncated += cut
        self.viterbi.row(initial, blank or not first, cut)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.viterbi.best())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _edited(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text, edit) of the repaired turns, from the sorted rows with each plan in front of its."""
    audit, at, place, conv, system = "", 0, 0, None, 0

    def inserted():
        nonlocal at, place
        while audit[at : at + 1] == "I":
            yield conv, place, (USER, ASSISTANT)[(place - system) % 2], "", "I"
            at, place = at + 1, place + 1

    for b in batches(parts):
        for c, turn, digest, kind, role, text in zip(*(x.to_pylist() for x in b.columns)):
            if kind == 0:
                audit, at, place, conv, system = text, 0, 0, c, 0
                yield from inserted()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                if edit == "K" and place == 0 and role[:1] == "s":
                    system = 1
                yield c, place, role if edit == "K" else (USER, ASSISTANT)[(place - system) % 2], text, edit
                place += 1
            yield from inserted()


def _streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The texts in order, the audit of each conversation in front of them."""
    whole = faults(rows).select("conv_id", "turn", "digest", F.lit(1).alias("kind"), "role", "text")
    head = plan.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return head.unionByName(whole).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("digest").asc_nulls_first(), "kind")


def repair(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place from 0, role, text, and the edit that made the row (K, R or I)."""

    def run(parts):
        held, size = [], 0
        for r in _edited(parts):
            held.append(r)
            size += 64 + len(r[3])
            if size > 1 << 20:
                yield _batch(held, _TURNS)
                held, size = [], 0
        if held:
            yield _batch(held, _TURNS)

    return _streamed(rows, plan).mapInArrow(run, TURNS)


def hashes(turns: DataFrame) -> DataFrame:
    """turns as repair() gives them -> conv_id, SHA-256 of the lines `role:text`. Reads them as they come, so they have to
    come from repair() itself, without a shuffle between."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(parts):
        conv, h = None, None
        for b in batches(parts):
            made = []
            for c, place, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if place == 0:
                    if h is not None:
                        made.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if made:
                yield _batch(made, schema)
        if h is not None:
            yield _batch([(conv, h.hexdigest())], schema)

    return turns.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20 (null: one space): 0 drops a row,
    1 empties its text, 2 takes [.!?] out of it, 3 repeats the row, 4 sets its role to user."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, text = F.crc32(named) % 20, F.coalesce("text", F.lit(" "))
    marked = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("k")).where("k <> 0")
    hit = marked.select(
        "conv_id", "turn", F.when(F.col("k") == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "k",
    )
    return hit.withColumn("_again", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_again", "k")


def digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation of ``ids`` (conv_id): its plan and the hash of its repaired turns. A conversation
    without rows has zeros, no edits and the hash of nothing."""
    plan = cut(plans(rows))
    parts = [ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), plan, hashes(repair(rows, plan))]
    one = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    numbers = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in _REPORT.names[1:-1]]
    return one.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The damage and the cheapest repair in DuckDB: CRC-32 by its table, the pass as a recursive query over rows."""
    table = "list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"
    named = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    crc = f"xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split({named}, ''), lambda z: ascii(z)::bigint), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)))"
    none = "{'c': 1000000000, 'a': '~'}"
    plus = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    closed = lambda s: f"{s}0 s0, {s}1 s1, least({s}2, {plus(s + '0', 2, 'I')}, {plus(s + '1', 2, 'I')}, {plus(s + '3', 2, 'I')}) s2, {s}3 y3"
    keep = lambda p, q, initial: f"case when not gone and initial = '{initial}' then {plus(f's{p}', 'extra', 'K')} else {none} end"
    rerole = lambda p: f"case when not gone then {plus(f's{p}', '2 + extra', 'R')} else {none} end"
    drop = lambda p: plus(f"s{p}", 3, "D")
    to_user = ", ".join(f"{keep(p, 2, 'u')}, {rerole(p)}" for p in (0, 1, 3))
    return rf"""
with recursive tab as materialized (select {table} t),
c0 as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, {crc} % 20 k from conversations, tab),
d as (
  select conv_id, turn, case k when 4 then 'user' else r end r, case k when 1 then '' when 2 then translate(x, '.!?', '') else x end x
  from (select * from c0 where k <> 0 union all select * from c0 where k = 3)),
f0 as (select *, r[1] initial, sha256(length(r) || ':' || r || x) g, regexp_extract(x, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) last from d),
f1 as (select *, row_number() over (partition by conv_id order by turn nulls first, g) i from f0),
f2 as (select *, row_number() over (partition by conv_id, g order by i) > 1 again, lag(initial) over (partition by conv_id order by i) prev from f1),
f as materialized (select *, last = '' or again gone, case when last <> '' and not again and last not in ('.', '!', '?') then 1 else 0 end extra from f2),
dp as (
  select conv_id, 0::bigint i, s0, s1, s2, least(y3, {plus('s2', 2, 'I')}) s3
  from (select conv_id, {closed('x')} from (select distinct conv_id, {{'c': 0, 'a': ''}} x0, {none} x1, {none} x2, {none} x3 from f))
  union all
  select conv_id, i, s0, s1, s2, least(y3, {plus('s2', 2, 'I')})
  from (select conv_id, i, {closed('x')} from (
    select f.conv_id, f.i, {drop(0)} x0, least({drop(1)}, {keep(0, 1, 's')}) x1, least({drop(2)}, {to_user}) x2, least({drop(3)}, {keep(2, 3, 'a')}, {rerole(2)}) x3
    from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1))),
best as (select conv_id, least(s0, s3) b from dp join (select conv_id e_id, max(i) e_i from f group by conv_id) on e_id is not distinct from conv_id and e_i = i),
steps as (select conv_id, b.a[j] e, j from best, unnest(range(1, length(b.a) + 1)) u(j)),
placed as (select *, count(*) filter (e <> 'I') over w i, count(*) filter (e <> 'D') over w p from steps window w as (partition by conv_id order by j)),
turns as (
  select q.conv_id, p, e, case when e <> 'I' then f.r end r, case when e = 'I' then '' else f.x end x, max(case when e = 'K' and p = 1 and f.initial = 's' then 1 else 0 end) over (partition by q.conv_id) sys
  from placed q left join f on f.conv_id is not distinct from q.conv_id and f.i = q.i where e <> 'D'),
texts as (select conv_id, sha256(string_agg((case when e = 'K' then r when (p - 1 - sys) % 2 = 0 then 'user' else 'assistant' end) || ':' || x, chr(10) order by p)) h from turns group by conv_id),
faults as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (last = '') blank, count(*) filter (last <> '' and again) duplicate,
    sum(extra) truncated, count(*) filter (prev is not null and prev || initial not in ('su', 'ua', 'au')) illegal from f group by conv_id)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(b.c, 0)::bigint "cost", coalesce(b.a, '') audit, coalesce(h, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) o
left join faults on faults.conv_id is not distinct from o.conv_id left join best on best.conv_id is not distinct from o.conv_id left join texts on texts.conv_id is not distinct from o.conv_id"""
