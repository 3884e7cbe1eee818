import hashlib
import itertools
import random
import zlib

import duckdb

from loomlake.llm import chat_repair as C

SF = "/root/testdata/sf0.001"


def legal(letters: str) -> bool:
    """letters: role initials, `?` for a free choice of user and assistant."""
    if not letters:
        return True
    rest = letters[1:] if letters[0] == "s" else letters
    return len(rest) > 0 and len(rest) % 2 == 0 and all(x in ("?", "ua"[i % 2]) for i, x in enumerate(rest))


def cheapest(rows):
    """All edits of rows (initial, gone, truncated), with up to two inserts in each place."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(g and e != "D" for e, (_, g, _) in zip(edits, rows)):
            continue
        for ins in itertools.product(range(3), repeat=len(rows) + 1):
            audit, out, cost = "I" * ins[0], "?" * ins[0], 2 * ins[0]
            for e, (initial, _, t), n in zip(edits, rows, ins[1:]):
                cost += {"K": 0, "R": 2, "D": 3}[e] + (t if e != "D" else 0) + 2 * n
                audit += e + "I" * n
                out += {"K": initial, "R": "?", "D": ""}[e] + "?" * n
            if (best is None or (cost, audit) < best) and legal(out):
                best = cost, audit
    return best


def test_pass_against_all_edits():
    r = random.Random(0)
    for _ in range(250):
        rows = [(r.choice("ssuuaax "), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(5))]
        v = C.Viterbi()
        for initial, gone, truncated in rows:
            v.row(initial, gone, truncated)
        assert v.best() == cheapest(rows), rows


def test_settled_audits_change_nothing():
    r = random.Random(1)
    for _ in range(20):
        rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(400)]
        v, w = C.Viterbi(), C.Viterbi()
        w._settle = lambda: None
        for x in rows:
            v.row(*x)
            w.row(*x)
        assert v.best() == w.best() and v.settled


def plain(rows):
    """The digest row of one conversation's damaged rows, in plain Python."""
    key = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    rows = sorted(rows, key=key)
    seen, faulty, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        faulty.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    v = C.Viterbi()
    for x in faulty:
        v.row(*x)
    cost, audit = v.best()
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    out, left = [], iter(rows)
    for e in audit:
        role, text = (None, "") if e == "I" else next(left)[1:]
        if e != "D":
            s = bool(out) and out[0][0][:1] == "s"
            out.append((role, text) if e == "K" else (("user", "assistant")[(len(out) - s) % 2], text))
    sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, audit int")
    got = {r.conv_id: tuple(r)[1:] for r in C.digests(C.damage(df), df).collect()}
    assert set(got) == {x[0] for x in rows}
    hit = damaged(rows)
    for conv in got:
        mine = [x[1:] for x in hit if x[0] == conv]
        assert got[conv] == (plain(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), conv


def test_rows_of_all_kinds(spark):
    r = random.Random(2)
    texts = ["Hi.", "no end", "", " \t\n", None, "é!\n", "a" * 50_000 + "?", "x\x85"]
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, 0, 1, 2, 3, 7]), r.choice(["user", "assistant", "system", None, "", "tool"]), r.choice(texts)) for _ in range(120)]
    check(spark, rows + rows[:10])


def test_conversation_that_holds_most_rows(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice(["a.", "b", f"{t}!"])) for t in range(3000)] + [(c, t, "user", "a.") for c in range(40) for t in range(2)]
    check(spark, rows)


def test_turns(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be."), (1, 1, "user", "Q?"), (1, 3, "user", "Q2?"), (2, 0, "x", "y.")], "conv_id long, turn long, role string, text string")
    plan = C.plans(rows)
    # rerole the second question, or delete one of the two and insert an answer: the first is cheaper
    assert {r.conv_id: (r.cost, r.audit) for r in plan.collect()} == {1: (2, "KKR"), 2: (3, "D")}
    turns = sorted(map(tuple, C.repair(rows, plan).collect()))
    assert turns == [(1, 0, "system", "Be.", "K"), (1, 1, "user", "Q?", "K"), (1, 2, "assistant", "Q2?", "R")]


def test_empty_and_oracle(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert C.digests(C.damage(df.limit(0)), df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    res = con.execute(C.oracle_sql())
    names = [d[0] for d in res.description]
    got = C.digests(C.damage(df), df).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(res.fetchall())
