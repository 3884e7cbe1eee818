import random
import time

import pytest

from loomlake import queries
from loomlake.operators import joins as J
from loomlake.operators.grid import overlap_join


@pytest.mark.parametrize("kind", ["small", "long", "points", "floats", "stacked"])
def test_pairs_once(spark, kind):
    r = random.Random(kind)

    def box(i):
        x, y = (r.choice([5, 5, 6]), 5) if kind == "stacked" else (r.randrange(9), r.randrange(9)) if kind == "points" else (r.randrange(-50, 100), r.randrange(100))
        w, h = (0, 0) if kind == "points" else (r.choice([1, 2, 150]), r.choice([0, 3, 99])) if kind == "long" else (r.randrange(6), r.randrange(6))
        if kind == "floats":
            x, y = x + r.random(), y / 7
        if i % 17 == 0:
            x = None
        if i % 13 == 0:
            w = -1
        return (None if i % 11 == 0 else i % 3, i, x, float(y), None if x is None else x + w, float(y + h))

    a, b = [box(i) for i in range(150)], [box(i) for i in range(120)]
    kinds = "double" if kind == "floats" else "long"
    left = spark.createDataFrame(a, f"g int, i int, x1 {kinds}, y1 double, x2 {kinds}, y2 double")
    right = spark.createDataFrame(b, f"g int, j int, u1 {kinds}, v1 double, u2 {kinds}, v2 double")
    good = lambda x: x[2] is not None and x[2] <= x[4]
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] is not None and p[0] == q[0] and good(p) and good(q) and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    axes = [("x1", "x2"), ("y1", "y2")], [("u1", "u2"), ("v1", "v2")]
    got = overlap_join(left, right, ["g"], *axes)
    assert sorted((x.i, x.j) for x in got.collect()) == want and want
    assert got.columns == ["g", "i", "x1", "y1", "x2", "y2", "j", "u1", "v1", "u2", "v2"]
    semi = overlap_join(left, right, ["g"], *axes, how="left_semi")
    assert {x.i for x in semi.collect()} == {i for i, _ in want}


def test_a_page_of_many_boxes(spark):
    """100,000 words and 20,000 shapes on one page, some of the page's size: against exact lookups, and pairs counted."""
    n, m = 100_000, 20_000
    words = spark.range(n).selectExpr("0 as page", "id as word_id", "(id % 1000) * 10 as x1", "(id div 1000) * 20 as y1", "(id % 1000) * 10 + 8 as x2", "(id div 1000) * 20 + 15 as y2")
    # shape s holds words of row s div 200 whose column is 5 * (s % 200) to 5 * (s % 200) + 2
    shapes = spark.range(m).selectExpr("0 as page", "id as shape_id", "(id % 200) * 50 as s_x1", "(id div 200) * 20 as s_y1", "(id % 200) * 50 + 28 as s_x2", "(id div 200) * 20 + 15 as s_y2")
    page = spark.range(2).selectExpr("0 as page", f"id + {m} as shape_id", "0 as s_x1", "0 as s_y1", "10000 as s_x2", "2000 as s_y2")
    t = time.time()
    got = J.first_container(words, shapes.unionByName(page))
    bad = got.selectExpr("shape_id", f"case when word_id % 1000 % 5 < 3 then (word_id div 1000) * 200 + (word_id % 1000) div 5 else {m} end as want").where("not shape_id <=> want")
    assert bad.count() == 0 and got.count() == n
    lines = J.with_neighbour(words.withColumnRenamed("word_id", "box_id"))  # 100 lines of 1,000 boxes
    assert lines.where("has_neighbour").count() == n
    one = spark.range(n).selectExpr("0 as page", "id as box_id", "id as x1", "0 as y1", "id + 1 as x2", "10 as y2")  # one line holds all
    assert J.with_neighbour(one).where("has_neighbour").count() == n
    alone = spark.range(n).selectExpr("0 as page", "id as box_id", "0 as x1", "id * 10 as y1", "5 as x2", "id * 10 + 9 as y2")
    assert J.with_neighbour(alone).where("has_neighbour").count() == 0
    assert time.time() - t < 120


def test_a_document_of_many_tokens(spark):
    n = 100_000
    tokens = spark.range(n).selectExpr("0 as doc_id", "id * 5 as t_start", "id * 5 + 4 as t_end", "id as x1", "0 as y1", "id + 1 as x2", "1 as y2")
    spans = spark.range(20_000).selectExpr("0 as doc_id", "id as span_id", "id * 25 as start", "id * 25 + 12 as end").unionByName(spark.createDataFrame([(0, 20_000, 0, 5 * n)], "doc_id int, span_id long, start long, end long"))
    got = J.span_boxes(spans, tokens)
    assert got.where(f"not (x1 = if(span_id = 20000, 0, span_id * 5) and x2 = if(span_id = 20000, {n}, span_id * 5 + 3))").count() == 0 and got.count() == 20_001


def test_copies_of_words_and_shapes(spark):
    """50,000 words and 50,000 shapes of one place: joined by place, as their pairs would be 2.5 billion."""
    n = 50_000
    words = spark.range(n).selectExpr("id % 1 as page", "id as word_id", "id % 1 as x1", "id % 1 as y1", "id % 1 + 10 as x2", "id % 1 + 10 as y2")
    shapes = spark.range(n).selectExpr("id % 1 as page", "id + 7 as shape_id", "id % 1 as s_x1", "id % 1 as s_y1", "id % 1 + 10 as s_x2", "id % 1 + 10 as s_y2")
    t = time.time()
    assert J.first_container(words, shapes).where("shape_id = 7").count() == n and time.time() - t < 30


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _random_boxes(r, n, ids):
    out = []
    for i in range(n):
        x, y, w, h = r.randrange(12), r.randrange(12), r.choice([0, 1, 4, 9, -2]), r.choice([1, 2, 8])
        out.append((None if i % 23 == 0 else r.choice([1, 1, 1, 1, 2, 3, 4]) if i % 9 else i, ids + i // 2, None if i % 19 == 0 else x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("few, most", [(64, 100_000), (4, 6), (4, 100_000), (0, 0)])
def test_first_container_on_pages_of_all_sizes(spark, few, most):
    """Small pages by lists and large ones by the grid: against all pairs; nulls, inverted boxes and repeated rows."""
    r = random.Random(7)
    words, shapes = _random_boxes(r, 150, 0), _random_boxes(r, 120, 50)
    held = lambda w, s: max(0, min(w[4], s[4]) - max(w[2], s[2])) * max(0, min(w[5], s[5]) - max(w[3], s[3]))
    own = lambda w, s: w[0] is not None and w[0] == s[0] and None not in (w[2], s[2]) and (a := (w[4] - w[2]) * (w[5] - w[3])) > 0 and held(w, s) > 0.85 * a
    want = sorted((repr(w), min((s[1] for s in shapes if own(w, s)), default=None)) for w in words)
    a = spark.createDataFrame(words, "page long, word_id int, x1 int, y1 int, x2 int, y2 int")
    b = spark.createDataFrame(shapes, "page long, shape_id int, s_x1 int, s_y1 int, s_x2 int, s_y2 int")
    got = J.first_container(a, b, few=few, most=most)
    assert got.columns == [*a.columns, "shape_id"]
    assert sorted((repr(tuple(x)[:-1]), x.shape_id) for x in got.collect()) == want and any(s is not None for _, s in want)


@pytest.mark.parametrize("few", [0, 5, 64])
def test_overlaps_of_groups_of_all_sizes(spark, few):
    r = random.Random(8)
    a, b = _random_boxes(r, 150, 0), _random_boxes(r, 120, 0)
    good = lambda x: x[2] is not None and x[2] <= x[4]
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] is not None and p[0] == q[0] and good(p) and good(q) and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    left = spark.createDataFrame(a, "g long, i int, x1 int, y1 int, x2 int, y2 int")
    right = spark.createDataFrame(b, "g long, j int, u1 int, v1 int, u2 int, v2 int")
    axes = [("x1", "x2"), ("y1", "y2")], [("u1", "u2"), ("v1", "v2")]
    assert sorted((x.i, x.j) for x in overlap_join(left, right, ["g"], *axes, few=few).collect()) == want
    assert {x.i for x in overlap_join(left, right, ["g"], *axes, how="left_semi", few=few).collect()} == {i for i, _ in want}


def test_small_pages_are_shuffled_once(spark):
    """What is dealt by page is not shuffled again, and other words and shapes once: the disk of a run is theirs."""
    words = spark.range(20_000).selectExpr("id div 4 as page", "id as word_id", "id % 7 as x1", "id % 5 as y1", "id % 7 + 8 as x2", "id % 5 + 4 as y2")
    shapes = spark.range(20_000).selectExpr("id div 4 as page", "id as shape_id", "id % 7 as s_x1", "id % 5 as s_y1", "id % 7 + 8 as s_x2", "id % 5 + 4 as s_y2")
    assert _exchanges(J.first_container(words, shapes)) == 2
    query = queries.QUERIES["containment_first_match"](spark, "/root/testdata/sf0.001")
    assert _exchanges(query) == 2
    near = J.overlap_join(words.repartition(4, "page"), shapes.repartition(4, "page"), ["page"], [("x1", "x2")], [("s_x1", "s_x2")])
    assert _exchanges(near) == 2
