"""Box and polygon geometry as Columns. A box is four Columns x1, y1, x2, y2, half open, valid if x1 < x2 and y1 < y2."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | int | float


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def fields(self) -> tuple[Column, ...]:
        return tuple(c.alias(n) for c, n in zip(self, self._fields, strict=True))

    def map(self, change) -> Box:
        return Box(*map(change, self))


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box in columns <prefix>x1<suffix>, ..."""
    return Box(*(F.col(f"{prefix}{n}{suffix}") for n in Box._fields))


def box_valid(b: Box) -> Column:
    return (b.x1 < b.x2) & (b.y1 < b.y2)


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def inter_box(a: Box, b: Box) -> tuple[Box, Column]:
    """Intersection box (given even where empty) and its area, 0 where empty."""
    cut = Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    return cut, F.when(box_valid(cut), area(cut)).otherwise(0)


def inter_area(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box, eps: float | None = None) -> Column:
    """Intersection over union; ``eps`` is added to the union, for boxes that may be empty."""
    inter = inter_area(a, b)
    union = area(a) + area(b) - inter
    return inter.cast("double") / (union.cast("double") + eps if eps else union)


def ios(a: Box, b: Box) -> Column:
    """Intersection over the area of the first box."""
    return inter_area(a, b).cast("double") / area(a)


def ios_smaller(a: Box, b: Box) -> Column:
    """Intersection over the area of the smaller box."""
    return inter_area(a, b).cast("double") / F.least(area(a), area(b))


def _int(c: Column) -> Column:
    return c.cast("int").cast("long")


def xywh2xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    """From centre and size; halves are rounded down, corners truncated."""
    half_w, half_h = F.floor(w / 2), F.floor(h / 2)
    return Box(_int(x - half_w), _int(y - half_h), _int(x + half_w), _int(y + half_h))


def rel_box(a: Box, b: Box, truncate: bool = True) -> Box:
    """``b`` in the coordinates of ``a``, in whole pixels and, if asked, cut to ``a``."""
    moved = Box(_int(b.x1 - a.x1), _int(b.y1 - a.y1), _int(b.x2 - a.x1), _int(b.y2 - a.y1))
    if not truncate:
        return moved
    w, h = _int(a.x2 - a.x1), _int(a.y2 - a.y1)
    inside = lambda c, size: F.least(F.greatest(c, F.lit(0)), size)
    return Box(inside(moved.x1, w), inside(moved.y1, h), inside(moved.x2, w), inside(moved.y2, h))


def abs_box(a: Box, b: Box) -> Box:
    """``b``, given in the coordinates of ``a``, in those of the image."""
    return Box(_int(a.x1 + b.x1), _int(a.y1 + b.y1), _int(a.x1 + b.x2), _int(a.y1 + b.y2))


def yolo_normalize(b: Box, width: Number, height: Number) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the image."""
    return (b.x1 + b.x2) / 2 / width, (b.y1 + b.y2) / 2 / height, (b.x2 - b.x1) / width, (b.y2 - b.y1) / height


def yolo_denormalize(xc: Column, yc: Column, w: Column, h: Column, width: Number, height: Number) -> Box:
    return Box((xc - w / 2) * width, (yc - h / 2) * height, (xc + w / 2) * width, (yc + h / 2) * height)


def clip_box(b: Box, width: Number, height: Number) -> Box:
    """Corners in order and inside the image."""
    inside = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most) if isinstance(most, (int, float)) else most)
    return Box(inside(F.least(b.x1, b.x2), width), inside(F.least(b.y1, b.y2), height), inside(F.greatest(b.x1, b.x2), width), inside(F.greatest(b.y1, b.y2), height))


def centers(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def polygon_bbox(points: Column) -> Box:
    """Enclosing box of an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def polygon_area(points: Column) -> Column:
    """Absolute shoelace sum; null for an empty polygon."""
    turned = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    crosses = F.zip_with(points, turned, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(points) > 0, F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, c: s + c)) / 2)


def pairs_of(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] as [[x0, y0], ...]."""
    n = F.floor(F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * 2 + 1, F.lit(2)))).otherwise(F.array().cast("array<array<double>>"))


def box_points(b: Box) -> Column:
    """The four corners, clockwise from the first."""
    d = b.map(lambda c: c.cast("double"))
    return F.array(F.array(d.x1, d.y1), F.array(d.x2, d.y1), F.array(d.x2, d.y2), F.array(d.x1, d.y2))


class Rotated(NamedTuple):
    cx: Column
    cy: Column
    w: Column
    h: Column
    angle: Column


def direction(points: Column, mode: str = "semantic_refer") -> Rotated:
    """Centre, sides and angle of four clockwise corners.

    ``semantic_refer`` takes the first side's direction; ``long_edge_refer`` that of the longer side, modulo pi;
    ``opencv_refer`` the one of the two directions in [0, pi/2], sides swapped where that is the second.
    """
    x, y = (lambda i: points[i][0]), (lambda i: points[i][1])
    cx, cy = (x(0) + x(1) + x(2) + x(3)) / 4, (y(0) + y(1) + y(2) + y(3)) / 4
    w, h = F.hypot(x(1) - x(0), y(1) - y(0)), F.hypot(x(2) - x(1), y(2) - y(1))
    first, second = F.atan2(-(y(1) - y(0)), x(1) - x(0)), F.atan2(-(y(2) - y(1)), x(2) - x(1))
    if mode == "semantic_refer":
        return Rotated(cx, cy, w, h, F.pmod(first, F.lit(2 * math.pi)))
    if mode == "long_edge_refer":
        return Rotated(cx, cy, w, h, F.pmod(F.when(w >= h, first).otherwise(second), F.lit(math.pi)))
    if mode == "opencv_refer":
        a, b = F.pmod(first, F.lit(math.pi)), F.pmod(second, F.lit(math.pi))
        use_first = a <= math.pi / 2
        return Rotated(cx, cy, F.when(use_first, w).otherwise(h), F.when(use_first, h).otherwise(w), F.when(use_first, a).otherwise(b))
    raise ValueError(f"unknown mode: {mode}")


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of numbers of equal length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
