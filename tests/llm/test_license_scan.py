import random
import re

import pytest

from loomlake.llm import license_scan as S


def base_places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(S.WORD, low)
    return len(w), sorted((i, label) for p, label in S.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_brute_force(spark):
    r = random.Random(0)
    pool = "cc by CC-BY general public license All rights reserved the é licensed under nc 4 0 mit released ...".split()
    texts = [" ".join(r.choices(pool, k=r.randrange(60))) for _ in range(150)] + [None, "", "é", "cc by " * 4000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string")
    rows = {r.doc_id: r for r in S.scan(df).collect()}
    for i, t in enumerate(texts):
        n, places = base_places(t)
        x = rows[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (n, len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert x.base_labels == ",".join(sorted({p[1] for p in places})) and 0 <= x.score <= 1
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))


@pytest.mark.parametrize(
    "text,label,found",
    [
        ("Foo. Released under the MIT License.", "mit", True),
        ("licensed under the very apache license version 2 0", "apache-2.0", True),
        ("licensed under the license version 2 of 0", "apache-2.0", False),
        ("this work is licensed under gnu general public license version 3", "gpl-3.0", True),
        ("released to the mit", "mit", False),
    ],
)
def test_near_wordings(spark, text, label, found):
    (row,) = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (label in row.labels.split(",")) is found


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (1, "x"), (None, None)], "doc_id long, text string")
    got = sorted([(r.doc_id, r.n_base, r.n_words) for r in S.scan(df).collect()], key=str)
    assert got == [(1, 0, 1), (1, 1, 2), (1, 1, 2), (None, 0, 0)]
    assert S.scan(df.limit(0)).count() == 0


def test_licence_texts_whole_edited_and_in_part(spark):
    """All whole texts are found in prose, also with a word in fifty changed or left out; a half shows in the score alone."""
    from loomlake.llm.license_texts import TEMPLATES

    r = random.Random(4)
    prose = lambda n: " ".join(r.choices("the of software and river stone is provided without any light".split(), k=n))
    long = [(t, label) for t, label in TEMPLATES.items() if len(t.split()) > 40]
    rows, want = [], {}
    for i, (t, label) in enumerate(long):
        w = t.split()
        edited = [x if j % 50 else r.choice(["", "stone light"]) for j, x in enumerate(w)]
        for kind, body in (("whole", t.upper()), ("edited", " ".join(edited)), ("half", " ".join(w[: len(w) // 2]))):
            rows.append((len(rows), f"{prose(30)} {body} {prose(200)}"))
            want[len(rows) - 1] = (kind, label)
    rows.append((len(rows), prose(20_000)))
    got = {x.doc_id: x for x in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, label) in want.items():
        labels = set(got[i].labels.split(","))
        if kind == "half" and label in ("apache-2.0", "gpl-3.0"):  # the first half holds a notice
            assert got[i].score > 0.35
        elif kind == "half":
            assert label not in labels and 0.35 < got[i].score < 0.75
        else:
            assert label in labels and got[i].score > (0.99 if kind == "whole" else 0.75)
    assert got[len(rows) - 1].labels == "" and got[len(rows) - 1].score < 0.2


def test_alignment_by_brute_force(spark):
    """Shares of a template's words by plain loops over all places of its grams."""
    r = random.Random(9)
    template = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi"
    rows = [(i, " ".join(r.choices(template.split() + ["zz"], k=8) + template.split()[r.randrange(8) :][: r.randrange(16)] + ["zz"] * r.randrange(3) + template.split()[r.randrange(8) :])) for i in range(60)]
    own = template.split()
    got = {(x.doc_id, x.start, round(x.share, 9)) for x in S.scan_spans(spark.createDataFrame(rows, "doc_id long, text string"), base={}, templates={template: "t"}).where("template is not null").collect()}
    want = set()
    for i, text in rows:
        w = text.split()
        places = {}
        for p in range(len(w) - 3):
            for q in range(len(own) - 3):
                if w[p : p + 4] == own[q : q + 4]:
                    places.setdefault(p - q, set()).add(q)
        spans = []
        for d in sorted(places):
            if spans and d - spans[-1][-1] <= S.GAP:
                spans[-1].append(d)
            else:
                spans.append([d])
        for s in spans:
            covered = {q + j for d in s for q in places[d] for j in range(4)}
            want.add((i, max(s[0], 0), round(len(covered) / len(own), 9)))
    assert got == want and want
