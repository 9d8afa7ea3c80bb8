"""Boxes, points and matrices as Columns. A box is a struct of x, y, width and height, y growing upwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def top(b: Column) -> Column:
    return b["y"] + b["height"]


def from_points(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return box(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def contains(b: Column, x: Column, y: Column) -> Column:
    return x.between(b["x"], right(b)) & y.between(b["y"], top(b))


def intersects(a: Column, b: Column) -> Column:
    return (right(a) >= b["x"]) & (right(b) >= a["x"]) & (top(a) >= b["y"]) & (top(b) >= a["y"])


def intersection(a: Column, b: Column) -> Column:
    """The common part; an empty box if there is none."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    zero = F.lit(0.0)
    return F.when(intersects(a, b), box(x, y, F.least(right(a), right(b)) - x, F.least(top(a), top(b)) - y)).otherwise(box(zero, zero, zero, zero))


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(top(a), top(b)) - y)


def expand(b: Column, margin: float) -> Column:
    return box(b["x"] - margin, b["y"] - margin, b["width"] + 2 * margin, b["height"] + 2 * margin)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common area over the smaller box's area, 0 if that is empty."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, area(intersection(a, b)) / least).otherwise(F.lit(0.0))


def is_empty(b: Column) -> Column:
    return (b["width"] <= 0) | (b["height"] <= 0)


def is_valid(b: Column) -> Column:
    return (b["width"] >= 0) & (b["height"] >= 0)


def center(b: Column) -> Column:
    return F.struct((b["x"] + b["width"] / 2).alias("x"), (b["y"] + b["height"] / 2).alias("y"))


def hull(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    left, low = F.min(x), F.min(y)
    return box(left, low, F.max(x + width) - left, F.max(y + height) - low)


def matrix(a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    return F.array(*[F.lit(float(x)) for x in (a, b, c, d, e, f)])


def translation(x: float, y: float) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scaling(x: float, y: float) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def rotation(angle: Column) -> Column:
    return F.array(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle), F.lit(0.0), F.lit(0.0))


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def multiply(m: Column, n: Column) -> Column:
    """First ``m``, then ``n``."""
    return F.array(
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


def is_identity(m: Column) -> Column:
    return m == matrix(1, 0, 0, 1, 0, 0)


def variation(values: Column) -> Column:
    """Aggregate: population standard deviation over the mean, 0 for a mean of 0."""
    mean = F.avg(values)
    return F.when(mean != 0, F.stddev_pop(values) / mean).otherwise(F.lit(0.0))


def variance(values: Column) -> Column:
    """Mean squared distance of an array's numbers from their mean; 0 without any."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n).otherwise(0.0)


def mostly_overlaps(a: Column, b: Column) -> Column:
    """Whether over half of the smaller box lies in the other."""
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(top(a), top(b)) - F.greatest(a["y"], b["y"])
    return (w > 0) & (h > 0) & (w * h > 0.5 * F.least(area(a), area(b)))


def image_dpi(px_width: Column, px_height: Column, page_width: Column, page_height: Column) -> Column:
    """Dots an inch of an image that spans its page, by its better side; 0 if the page's size isn't known."""
    side = lambda px, points: F.when(points > 0, F.floor(px * 72 / points + 0.5)).otherwise(0)
    return F.greatest(side(px_width, page_width), side(px_height, page_height), F.lit(0)).cast("int")


def upscale(dpi: Column, least: int = 50, target: int = 300) -> Column:
    """How much to enlarge an image towards the target, 3 at most; 1 near the target and for implausible figures."""
    return F.when((dpi < least) | (dpi >= target - 50), 1.0).otherwise(F.least(F.lit(3.0), F.lit(float(target)) / dpi))


def coverage(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Share of the page that a box covers, from 0 to 1."""
    page = page_width * page_height
    return F.when(page > 0, F.least(F.lit(1.0), F.abs(width * height) / page)).otherwise(0.0)


def variation_of(values: Column) -> Column:
    """Standard deviation of an array's numbers over their mean; 0 for under two of them or a mean of 0."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
    return F.when((F.size(values) < 2) | (mean == 0), 0.0).otherwise(F.sqrt(variance(values)) / mean)
