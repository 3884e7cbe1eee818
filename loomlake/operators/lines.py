"""Lines of words on a page whose scan may be turned: words are turned back by the page's angle, then walked left and right.

The angle of a page is the median of the angles of the upper and lower sides of its words. Turned about the page's middle,
corners are cut to whole pixels, and words are taken by the height of their centres. A word that has no line yet opens one
and looks to the left and then to the right from the middle of its side, as far as it is wide, for the first pixel of
another word; words found continue the line from theirs, until nothing or a word that has a line is met. Where words
cover each other, the one whose centre is lower is seen. Lines are numbered by the mean of their centres, words in a line
by the first corner's x.

The walk decides word by word, so a page is one group; no picture is made. Small pages walk together, one step of all of
them at a time, each looking through all its words; a page of more than ``SMALL`` words walks alone, and its words are found
by bands of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a page that walks together with others, at most.
SMALL = 64
CORNERS = [f"{a}{i}" for i in (1, 2, 3, 4) for a in "xy"]


def turned(corners: np.ndarray, starts: np.ndarray, page: np.ndarray, width: np.ndarray, height: np.ndarray, auto_rotate: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The angles of pages, in degrees, and their words (n x 4 x 2, clockwise from the upper left) turned back by them about
    the pages' middles, cut to whole pixels. starts: the first word of each page; page: the page of each word."""
    side = lambda a, b: np.degrees(np.arctan2(corners[:, b, 1] - corners[:, a, 1], corners[:, b, 0] - corners[:, a, 0]))
    angle = np.zeros(len(starts))
    if auto_rotate:
        both, of = np.concatenate([side(3, 2), side(0, 1)]), np.concatenate([page, page])
        both = both[np.lexsort((both, of))]
        n = np.diff(np.append(starts, len(page)))
        angle = (both[2 * starts + n - 1] + both[2 * starts + n]) / 2
    middle = np.stack([width // 2, height // 2], axis=1).astype(float)[page][:, None, :]
    cos, sin = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    back = np.stack([cos, -sin, sin, cos], axis=1).reshape(-1, 2, 2)
    return angle, np.trunc((corners - middle) @ back[page] + middle).astype(np.int64)


def row_spans(quads: np.ndarray, y: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last pixel of each quad (n x 4 x 2) in row y, or in its own row; the first is beyond the last where
    there is none."""
    y = np.asarray(y)[..., None]
    a, b = quads, np.roll(quads, -1, axis=1)
    low, high = np.minimum(a[:, :, 1], b[:, :, 1]), np.maximum(a[:, :, 1], b[:, :, 1])
    meets, flat = (low <= y) & (y <= high), a[:, :, 1] == b[:, :, 1]
    step = np.where(flat, 1, b[:, :, 1] - a[:, :, 1])
    x = np.floor(a[:, :, 0] + (b[:, :, 0] - a[:, :, 0]) * ((y - a[:, :, 1]) / step) + 0.5).astype(np.int64)
    left = np.where(meets, np.where(flat, np.minimum(a[:, :, 0], b[:, :, 0]), x), np.iinfo(np.int64).max).min(axis=1)
    right = np.where(meets, np.where(flat, np.maximum(a[:, :, 0], b[:, :, 0]), x), np.iinfo(np.int64).min).max(axis=1)
    return left, right


class _Page:
    """The words of a page, by the height of their centres."""

    def __init__(self, quads: np.ndarray):
        self.quads = quads
        top, bottom = quads[:, :, 1].min(axis=1), quads[:, :, 1].max(axis=1)
        self.band = max(1, int(np.median(bottom - top)) + 1)
        first, last = top // self.band, bottom // self.band
        self.bands: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
            for k in range(a, b + 1):
                self.bands.setdefault(k, []).append(i)

    def seen(self, word: int, y: int, start: int, stop: int, step: int) -> int | None:
        """The word that is seen first from start to stop (not itself) in row y, other than this one."""
        near = np.array(self.bands.get(y // self.band, []), np.int64)
        if not len(near):
            return None
        left, right = row_spans(self.quads[near], y)
        low, high = (start, stop - 1) if step > 0 else (stop + 1, start)
        here = (left <= high) & (right >= low) & (left <= right)
        near, left, right = near[here], np.maximum(left[here], low), np.minimum(right[here], high)
        own = near == word
        a, b = (int(left[own][0]), int(right[own][0])) if own.any() else (1, 0)
        if step > 0:
            at = np.where((near < word) & (a <= left) & (left <= b), b + 1, left)
            at[(at > right) | own] = high + 1
            x = int(at.min(initial=high + 1))
            ok = x <= high
        else:
            at = np.where((near < word) & (a <= right) & (right <= b), a - 1, right)
            at[(at < left) | own] = low - 1
            x = int(at.max(initial=low - 1))
            ok = x >= low
        return int(near[(left <= x) & (x <= right)].max()) if ok else None


def walk(quads: np.ndarray) -> np.ndarray:
    """The line (in order of opening) of each of the words, which are given by the height of their centres."""
    page, line = _Page(quads), np.full(len(quads), -1, np.int64)
    right_edge = int(quads[:, :, 0].max(initial=0))
    lines = 0
    for first in range(len(quads)):
        if line[first] >= 0:
            continue
        line[first] = lines
        for step in (-1, 1):
            word = first
            while True:
                q = quads[word]
                # the middle of the side towards which it looks, cut to whole pixels
                corners = q[[0, 3]] if step < 0 else q[[1, 2]]
                x, y = (int(v / 2) for v in corners.sum(axis=0))
                wide = int(q[:, 0].max() - q[:, 0].min())
                found = page.seen(word, y, x - 1, max(x - wide, -1), -1) if step < 0 else page.seen(word, y, x, min(x + wide, right_edge - 1), 1)
                if found is None or line[found] >= 0:
                    break
                line[found] = lines
                word = found
        lines += 1
    return line


def walk_together(quads: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """walk() of many pages, the words of one after the other; a step of every page at a time."""
    n, line = np.diff(np.append(starts, len(quads))), np.full(len(quads), -1, np.int64)
    left_x, right_x = quads[:, :, 0].min(axis=1), quads[:, :, 0].max(axis=1)
    edge = np.maximum(np.maximum.reduceat(right_x, starts), 0)
    x_of = {-1: (quads[:, 0, 0] + quads[:, 3, 0]) // 2, 1: (quads[:, 1, 0] + quads[:, 2, 0]) // 2}
    y_of = {-1: (quads[:, 0, 1] + quads[:, 3, 1]) // 2, 1: (quads[:, 1, 1] + quads[:, 2, 1]) // 2}
    todo = np.arange(len(starts))
    first, lines, step = starts.copy(), np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    word = first.copy()
    line[first] = 0
    while len(todo):
        at, right = word[todo], step[todo] > 0
        x, y = np.where(right, x_of[1][at], x_of[-1][at]), np.where(right, y_of[1][at], y_of[-1][at])
        wide = right_x[at] - left_x[at]
        low = np.where(right, x, np.maximum(x - wide, -1) + 1)
        high = np.where(right, np.minimum(x + wide, edge[todo] - 1) - 1, x - 1)
        found = _seen_together(quads, starts[todo], n[todo], at, y, low, high, right)
        on = (found >= 0) & (line[found] < 0)
        line[found[on]] = lines[todo[on]]
        word[todo[on]] = found[on]
        turn, end = todo[~on & ~right], todo[~on & right]
        step[turn], word[turn] = 1, first[turn]
        if len(end):
            k = ragged(starts[end], n[end])
            opens = np.minimum.reduceat(np.where(line[k] < 0, k, len(line)), np.cumsum(n[end]) - n[end])
            more = opens < len(line)
            end, opens = end[more], opens[more]
            lines[end] += 1
            first[end] = word[end] = opens
            step[end] = -1
            line[opens] = lines[end]
            over = np.zeros(len(starts), bool)
            over[todo[~on & right]] = True
            over[end] = False
            todo = todo[~over[todo]]
    return line


def _seen_together(quads, starts, n, word, y, low, high, right) -> np.ndarray:
    """_Page.seen() of one word of each page, from low to high or, where not right, from high to low; -1 where none is seen."""
    k, of, cuts = ragged(starts, n), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    begin, end = row_spans(quads[k], y[of])
    lo, hi, me = low[of], high[of], word[of]
    here = (begin <= hi) & (end >= lo) & (begin <= end)
    begin, end, own = np.maximum(begin, lo), np.minimum(end, hi), k == me
    a, b = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    mine = own & here
    a[of[mine]], b[of[mine]] = begin[mine], end[mine]
    a, b, go = a[of], b[of], right[of]
    # from the left the first pixel that is not covered by the word itself; from the right the same, mirrored
    pos = np.where((k < me) & (a <= begin) & (begin <= b), b + 1, begin)
    pos = np.where(go, pos, np.where((k < me) & (a <= end) & (end <= b), a - 1, end))
    none = ~here | own | np.where(go, pos > end, pos < begin)
    far = np.iinfo(np.int64).max
    x = np.minimum.reduceat(np.where(none, far, np.where(go, pos, -pos)), cuts)
    ok, x = x < far, np.where(right, x, -x)
    hit = here & (begin <= x[of]) & (x[of] <= end)
    return np.where(ok, np.maximum.reduceat(np.where(hit, k, -1), cuts), -1)


def page_lines(corners: np.ndarray, starts: np.ndarray, width: np.ndarray, height: np.ndarray, auto_rotate: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(angle, line, place) of the words of pages that follow each other, the last two from 1. starts: the first word of each
    page; width, height: of each page. Words of one height are taken as they come."""
    n = np.diff(np.append(starts, len(corners)))
    page = np.repeat(np.arange(len(starts)), n)
    angle, corners = turned(corners, starts, page, width, height, auto_rotate)
    order = np.lexsort((corners[:, :, 1].mean(axis=1), page))
    # what lies left of and above the page is moved onto it
    corners = corners[order]
    corners = corners + np.maximum(0, -np.minimum.reduceat(corners.min(axis=1), starts))[page][:, None, :]
    opened, small = np.empty(len(corners), np.int64), n <= SMALL
    for i in np.flatnonzero(~small):
        opened[starts[i] : starts[i] + n[i]] = walk(corners[starts[i] : starts[i] + n[i]])
    if small.any():
        k = ragged(starts[small], n[small])
        opened[k] = walk_together(corners[k], np.cumsum(n[small]) - n[small])
    count = np.maximum.reduceat(opened, starts) + 1
    before = np.cumsum(count) - count
    opened += before[page]
    mean = np.bincount(opened, corners[:, :, 1].mean(axis=1)) / np.bincount(opened)
    of = np.repeat(np.arange(len(starts)), count)
    number = np.empty(len(mean), np.int64)
    by_mean = np.lexsort((mean, of))
    number[by_mean] = np.arange(len(mean)) - before[of] + 1
    line, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    line[order] = number[opened]
    by_line = np.lexsort((corners[:, 0, 0], number[opened], page))
    head = np.flatnonzero(np.append(True, np.diff(number[opened][by_line]) + np.diff(page[by_line]) * (len(page) + 1) != 0))
    place[order[by_line]] = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order)))) + 1
    return angle[page], line, place


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, none of them empty, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def line_walk(words: DataFrame, page: str = "page", word: str = "word_id", auto_rotate: bool = True) -> DataFrame:
    """words (page, word_id, x1, y1, ... x4, y4, width, height) with angle, line and place in it, both from 1. Words of one
    height are taken by word_id, words of one line and x by their height. Words with a null corner have neither."""
    spark, kinds = words.sparkSession, dict(words.dtypes)
    slim = words.select(F.col(page).alias("_page"), F.col(word).alias("_n"), *[F.col(c).cast("double").alias(c) for c in CORNERS], F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    schema = slim.select("_page", "_n").schema.add("angle", "double").add("line", "long").add("place", "long")

    def run(batches):
        held = []
        for b in batches:
            new = np.flatnonzero(b.column("_new").to_numpy(zero_copy_only=False)) if b.num_rows else []
            if len(new) and (held or new[-1]):  # the last page may go on in the next batch
                ready = pa.Table.from_batches([*held, b.slice(0, new[-1])])
                if ready.num_rows:
                    yield from _walked(ready, auto_rotate).to_batches()
                held = [b.slice(new[-1])]
            elif b.num_rows:
                held.append(b)
        if held:
            yield from _walked(pa.Table.from_batches(held), auto_rotate).to_batches()

    whole = ~F.exists(F.array(*CORNERS), lambda c: c.isNull())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted by the window: the first word of each page is marked
    first = F.row_number().over(Window.partitionBy("_page").orderBy("_n")) == 1
    found = slim.where(whole).repartition(tasks, "_page").withColumn("_new", first).mapInArrow(run, schema)
    return words.join(found, F.col(page).eqNullSafe(F.col("_page")) & (F.col(word) == F.col("_n")), "left").drop("_page", "_n")


def _walked(rows: pa.Table, turn: bool) -> pa.Table:
    """Whole pages, one after the other."""
    corners = np.column_stack([rows.column(c).to_numpy() for c in CORNERS]).reshape(-1, 4, 2)
    starts = np.flatnonzero(rows.column("_new").to_numpy())
    width, height = (rows.column(c).to_numpy()[starts].astype(np.int64) for c in ("width", "height"))
    angle, line, place = page_lines(corners, starts, width, height, turn)
    return pa.table([rows.column("_page"), rows.column("_n"), pa.array(angle), pa.array(line), pa.array(place)], names=["_page", "_n", "angle", "line", "place"])
