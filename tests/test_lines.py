import math
import random
import time

import numpy as np

from loomlake.operators import lines as L


def picture(quads):
    """The numbers, from 1, of the words seen at each pixel."""
    w, h = quads[:, :, 0].max() + 1, quads[:, :, 1].max() + 1
    out = np.zeros((h, w), int)
    for i, q in enumerate(quads.tolist(), 1):
        for y in range(min(p[1] for p in q), max(p[1] for p in q) + 1):
            xs = []
            for (xa, ya), (xb, yb) in zip(q, q[1:] + q[:1]):
                if ya == yb == y:
                    xs += [xa, xb]
                elif ya != yb and min(ya, yb) <= y <= max(ya, yb):
                    xs.append(math.floor(xa + (xb - xa) * ((y - ya) / (yb - ya)) + 0.5))
            out[y, min(xs) : max(xs) + 1] = i
    return out


def by_pixels(quads):
    """The walk over a picture, pixel by pixel."""
    seen, line, lines = picture(quads), [None] * len(quads), 0
    for first in range(len(quads)):
        if line[first] is not None:
            continue
        line[first] = lines
        for step in (-1, 1):
            at = first
            while True:
                q = quads[at].tolist()
                side = (q[0], q[3]) if step < 0 else (q[1], q[2])
                x, y = (int((side[0][k] + side[1][k]) / 2) for k in (0, 1))
                wide = max(p[0] for p in q) - min(p[0] for p in q)
                xs = range(x - 1, max(x - wide, -1), -1) if step < 0 else range(x, min(x + wide, seen.shape[1] - 2))
                hit = next((seen[y, k] - 1 for k in xs if seen[y, k] and seen[y, k] - 1 != at), None)
                if hit is None or line[hit] is not None:
                    break
                line[hit] = lines
                at = hit
        lines += 1
    return line


def words(r, rows=6, columns=5, jitter=3):
    out = []
    for i in range(rows):
        for k in range(columns):
            x, y = 40 + k * 50 + r.randrange(-jitter, jitter + 1), 40 + i * 22 + r.randrange(-jitter, jitter + 1)
            w, h = r.randrange(20, 48), r.randrange(8, 18)
            if r.random() < 0.9:
                out.append([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    return out


def turn(quad, degrees, cx, cy):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy) for x, y in quad]


def test_walk_against_pixels():
    r = random.Random(0)
    for k in range(60):
        quads = words(r, jitter=r.choice([0, 3, 12])) if k % 3 else [[(x + r.randrange(-4, 5), y + r.randrange(-4, 5)) for x, y in q] for q in words(r)]
        if k % 5 == 0:
            quads = [turn(q, r.uniform(-20, 20), 150, 100) for q in quads]
        quads = np.array(quads).astype(int)
        quads = quads + np.maximum(0, -quads.reshape(-1, 2).min(axis=0))
        quads = quads[np.argsort(quads[:, :, 1].mean(axis=1), kind="stable")]
        assert L.walk(quads).tolist() == by_pixels(quads)


def test_pages_that_are_turned(spark):
    """Clean rows of words, each page turned by its own angle: rows come back as lines."""
    rows, want = [], {}
    for page, degrees in enumerate([0, 7, -12, 33, 85]):
        n = 0
        for i in range(8):
            for k in range(6):
                x, y = 100 + k * 60, 100 + i * 40
                quad = turn([(x, y), (x + 50, y), (x + 50, y + 20), (x, y + 20)], degrees, 400, 300)
                word = (n * 29) % 48
                rows.append((page, word, *[v for p in quad for v in p], 800, 600))
                want[page, word] = (i + 1, k + 1)
                n += 1
    rows.append((9, 1, *[None] * 8, 10, 10))
    df = spark.createDataFrame(rows, "page int, word_id int, " + ", ".join(f"{c} double" for c in L.CORNERS) + ", width int, height int")
    got = L.line_walk(df).collect()
    assert {(r.page, r.word_id): (r.line, r.place) for r in got if r.page < 9} == want
    assert [r.line for r in got if r.page == 9] == [None] and len(got) == len(rows)
    assert {(r.page, round(r.angle, 6)) for r in got if r.page < 9} == {(0, 0.0), (1, 7.0), (2, -12.0), (3, 33.0), (4, 85.0)}
    plain = L.line_walk(df.where("page = 4"), auto_rotate=False)
    assert {(4, r.word_id): (r.line, r.place) for r in plain.collect()} != {k: v for k, v in want.items() if k[0] == 4}


def test_small_pages_walk_together(spark):
    """Pages of all sizes in one call, each as when it walks alone over pixels; and 60,000 small ones within seconds."""
    r, pages = random.Random(3), []
    for k in range(120):
        quads = np.array([turn(q, r.uniform(-20, 20) * (k % 2), 150, 100) for q in words(r, rows=r.randrange(1, 6), columns=r.randrange(1, 5), jitter=12)] or [[(9, 9)] * 4]).astype(int)
        quads = quads + np.maximum(0, -quads.reshape(-1, 2).min(axis=0))
        pages.append(quads[np.argsort(quads[:, :, 1].mean(axis=1), kind="stable")])
    n = np.array([len(p) for p in pages])
    got = L.walk_together(np.concatenate(pages), np.cumsum(n) - n)
    assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [by_pixels(p) for p in pages]
    x, y = "(id * 37 % 8 * 60 + 100)", "(id * 11 % 6 * 40 + 100)"
    df = spark.range(240_000).selectExpr("id div 4 as page", "id % 4 as word_id", *[f"cast({e} as double) as {c}" for c, e in zip(L.CORNERS, [x, y, f"{x} + 50", y, f"{x} + 50", f"{y} + 20", x, f"{y} + 20"])], "800 as width", "600 as height")
    t = time.time()
    assert L.line_walk(df).where("line between 1 and 4 and place between 1 and 4").count() == 240_000 and time.time() - t < 40
