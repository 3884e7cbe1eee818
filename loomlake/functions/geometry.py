"""Numbers and boxes as column expressions. Python's round() is half-even, so bround stands for it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image sizes.
FACTOR, MIN_PIXELS, MAX_PIXELS, MAX_RATIO = 28, 4 * 28**2, 16384 * 28**2, 200


def round_by(n: Column, f: int) -> Column:
    return F.bround(n / f) * f


def ceil_by(n: Column, f: int) -> Column:
    return F.ceil(n / f) * f


def floor_by(n: Column, f: int) -> Column:
    return F.floor(n / f) * f


def smart_resize(width: Column, height: Column, factor: int = FACTOR, low: int = MIN_PIXELS, high: int = MAX_PIXELS) -> Column:
    """(width, height): multiples of factor near the size, pixels within bounds; an extreme ratio is an error."""
    at_least = lambda c: F.greatest(F.lit(factor), c)
    w, h = at_least(round_by(width, factor)), at_least(round_by(height, factor))
    shrink, grow = F.sqrt(width * height / high), F.sqrt(low / (width * height))
    side = lambda a, r: F.when(w * h > high, at_least(floor_by(a / shrink, factor))).when(w * h < low, ceil_by(a * grow, factor)).otherwise(r).cast("int")
    bad = F.greatest(width, height) / F.least(width, height) > MAX_RATIO
    guard = lambda c: F.when(bad, F.raise_error(F.lit(f"aspect ratio above {MAX_RATIO}")).cast("int")).otherwise(c)
    return F.struct(guard(side(width, w)).alias("width"), guard(side(height, h)).alias("height"))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def xywh_to_share(x, y, w, h, width, height, digits: int = 4) -> Column:
    return F.array(*[F.round(clamp01(c), digits) for c in (x / width, y / height, (x + w) / width, (y + h) / height)])


def normalize(x1, y1, x2, y2, width, height) -> Column:
    """Shares within 0 and 1; an empty or inverted box is zeros."""
    zero = F.array(*[F.lit(0.0)] * 4)
    ok = (width > 0) & (height > 0) & (x1 < x2) & (y1 < y2)
    return F.when(ok, F.array(*[clamp01(c) for c in (x1 / width, y1 / height, x2 / width, y2 / height)])).otherwise(zero)


def denormalize_box(box: Column, width: Column, height: Column) -> Column:
    size = F.array(width, height, width, height)
    return F.transform(F.arrays_zip(box.alias("b"), size.alias("s")), lambda p: F.bround(p["b"] * p["s"]).cast("int"))


def quad_to_box(quad: Column) -> Column:
    """(x1, y1, .., x4, y4) -> left, top, right, bottom."""
    xs, ys = (F.transform(F.sequence(F.lit(k), F.lit(k + 6), F.lit(2)), lambda i: F.element_at(quad, i)) for k in (1, 2))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def rotated_to_box(x, y, w, h, degrees, width, height) -> Column:
    """A rectangle in percent, turned about its first corner, as the box around it in shares of three digits."""
    px, py, pw, ph = x / 100 * width, y / 100 * height, w / 100 * width, h / 100 * height
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    xs, ys = [px, px + pw * c, px - ph * s, px + pw * c - ph * s], [py, py + pw * s, py + ph * c, py + pw * s + ph * c]
    box = [(F.least(*xs), width), (F.least(*ys), height), (F.greatest(*xs), width), (F.greatest(*ys), height)]
    return F.array(*[F.round(v.cast("int") / size, 3) for v, size in box])


def flip_y(x1, y1, x2, y2, height) -> Column:
    return F.array(x1, height - y2, x2, height - y1)


def fit_longest(width: Column, height: Column, most: int = 2048) -> Column:
    f = F.least(F.lit(1.0), F.lit(float(most)) / width, F.lit(float(most)) / height)
    return F.struct(F.floor(width * f).cast("int").alias("width"), F.floor(height * f).cast("int").alias("height"))


def rescale(c: Column, factor: float = 0.48) -> Column:
    return c * factor


def area_ratio(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """The share of a's area within b, 0 for an empty a."""
    area = (ax2 - ax1) * (ay2 - ay1)
    inter = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    return F.when(area > 0, inter / area).otherwise(0.0)


def angle(x1, y1, x2, y2) -> Column:
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def rotate(x, y, degrees) -> Column:
    r = degrees * (math.pi / 180)
    return F.struct((x * F.cos(r) - y * F.sin(r)).alias("x"), (x * F.sin(r) + y * F.cos(r)).alias("y"))


def equal_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """0 to n - 1; the last bin holds its upper bound."""
    return F.when(high == low, n - 1).otherwise(F.least(F.floor((x - low) / (high - low) * n), F.lit(n - 1))).cast("int")
