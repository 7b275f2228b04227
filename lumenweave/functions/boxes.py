"""Bounding boxes as arrays of four or five numbers: xywh, xyxy, or centre, size and angle (xywha). Computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(box: Column, *indexes: int) -> list[Column]:
    return [F.get(box, F.lit(i)).cast("double") for i in indexes]


def xywh_to_xyxy(box: Column) -> Column:
    x, y, w, h = _at(box, 0, 1, 2, 3)
    return F.array(x, y, x + w, y + h)


def xyxy_to_xywh(box: Column) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return F.array(a, b, c - a, d - b)


def xywh_to_xywha(box: Column) -> Column:
    """Centre, size, and angle 0."""
    x, y, w, h = _at(box, 0, 1, 2, 3)
    return F.array(x + w / 2, y + h / 2, w, h, F.lit(0.0))


def xywha_to_xyxy(box: Column) -> Column:
    """The bounding rectangle of a rotated box; the angle is in degrees."""
    cx, cy, w, h, angle = _at(box, 0, 1, 2, 3, 4)
    cos, sin = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    half_w, half_h = (cos * w + sin * h) / 2, (cos * h + sin * w) / 2
    return F.array(cx - half_w, cy - half_h, cx + half_w, cy + half_h)


def convert(box: Column, source: str, target: str) -> Column:
    """Between ``xywh``, ``xyxy`` and ``xywha``; unknown pairs raise."""
    known = {
        ("xywh", "xyxy"): xywh_to_xyxy, ("xyxy", "xywh"): xyxy_to_xywh, ("xywh", "xywha"): xywh_to_xywha, ("xywha", "xyxy"): xywha_to_xyxy,
        ("xyxy", "xywha"): lambda b: xywh_to_xywha(xyxy_to_xywh(b)), ("xywha", "xywh"): lambda b: xyxy_to_xywh(xywha_to_xyxy(b)),
    }
    if source == target:
        return box
    if (source, target) not in known:
        raise ValueError(f"no conversion from {source} to {target}")
    return known[source, target](box)


def area(box: Column) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return (c - a) * (d - b)


def iou(first: Column, second: Column) -> Column:
    """Intersection over union of two xyxy boxes; null if both are empty."""
    a, b, c, d = _at(first, 0, 1, 2, 3)
    e, f, g, h = _at(second, 0, 1, 2, 3)
    zero = F.lit(0.0)
    common = F.greatest(F.least(c, g) - F.greatest(a, e), zero) * F.greatest(F.least(d, h) - F.greatest(b, f), zero)
    return F.try_divide(common, area(first) + area(second) - common)


def clip(box: Column, height: Column, width: Column) -> Column:
    """The xyxy box inside the picture; a coordinate that is no finite number raises."""
    finite = F.forall(box, lambda v: ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    checked = F.when(finite, box).otherwise(F.raise_error(F.lit("a box has a coordinate that is not finite")))
    a, b, c, d = _at(checked, 0, 1, 2, 3)
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    return F.array(inside(a, width), inside(b, height), inside(c, width), inside(d, height))


def nonempty(box: Column, threshold: float = 0.0) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return (c - a > threshold) & (d - b > threshold)


def inside(box: Column, height: Column, width: Column, margin: float = 0.0) -> Column:
    """Whether the xyxy box lies in the picture, up to a margin: at least ``-margin`` and below the size plus the margin."""
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return (a >= -margin) & (b >= -margin) & (c < width + margin) & (d < height + margin)


def center(box: Column) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return F.array((a + c) / 2, (b + d) / 2)


def scale(box: Column, x: Column, y: Column) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return F.array(a * x, b * y, c * x, d * y)


def quantize(box: Column, bins: int, height: Column, width: Column) -> Column:
    """Coordinates as bin numbers from 0 to ``bins - 1``, rounded half to even."""
    a, b, c, d = _at(box, 0, 1, 2, 3)
    to_bin = lambda v, most: F.bround(v / most.cast("double") * (bins - 1), 0).cast("int")
    return F.array(to_bin(a, width), to_bin(b, height), to_bin(c, width), to_bin(d, height))


def dequantize(box: Column, bins: int, height: Column, width: Column) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    back = lambda v, most: v / (bins - 1) * most.cast("double")
    return F.array(back(a, width), back(b, height), back(c, width), back(d, height))


def clamp_xywh(box: Column, width: Column, height: Column) -> Column:
    """Negative corners become 0; width and height are at most the picture's."""
    x, y, w, h = _at(box, 0, 1, 2, 3)
    return F.array(F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0)), F.least(w, width.cast("double")), F.least(h, height.cast("double")))


def denormalize(box: Column, width: Column, height: Column) -> Column:
    return scale(box, width.cast("double"), height.cast("double"))


def normalize(box: Column, width: Column, height: Column) -> Column:
    a, b, c, d = _at(box, 0, 1, 2, 3)
    return F.array(F.try_divide(a, width), F.try_divide(b, height), F.try_divide(c, width), F.try_divide(d, height))


def resize_target(size: Column, target: int, patch: int, *, variable: bool) -> Column:
    """The side after resizing: the target, or the size rounded up to whole patches if that is less."""
    if not variable:
        return F.lit(target)
    return F.least(F.lit(target), (F.ceil(size / patch) * patch).cast("int"))
