"""Boxes as structs <x1, y1, x2, y2>: overlap, suppression and fusion within bounded groups, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column, pixel: float = 0.0) -> Column:
    return (b["x2"] - b["x1"] + pixel) * (b["y2"] - b["y1"] + pixel)


def overlap(a: Column, b: Column, pixel: float = 0.0) -> Column:
    """Area of the intersection; ``pixel`` is 1 where boxes count their last pixel."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + pixel
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + pixel
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, pixel: float = 0.0) -> Column:
    """Intersection over union, 0 for two empty boxes."""
    both = overlap(a, b, pixel)
    return F.coalesce(F.try_divide(both, area(a, pixel) + area(b, pixel) - both), F.lit(0.0))


def greedy_keep(ranked: Column, kind: str, clash: callable) -> Column:
    """The elements of ``ranked``, best first, that clash with none kept before; ``kind`` is the array's type."""
    return F.aggregate(ranked, F.expr(f"CAST(array() AS {kind})"), lambda kept, x: F.when(F.exists(kept, lambda k: clash(k, x)), kept).otherwise(F.array_append(kept, x)))


def suppress(ranked: Column, kind: str, limit: float, pixel: float = 0.0) -> Column:
    """Non-maximum suppression: a box goes if its overlap with a kept one is ``limit`` or more."""
    return greedy_keep(ranked, kind, lambda k, x: iou(k["box"], x["box"], pixel) >= limit)
