"""Boxes on pages as columns; a box is a struct x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_SIDE = 1.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def normalised(b: Column, width: Column, height: Column) -> Column:
    """Corners in order and inside the page; null for boxes at most one unit wide or high, or with a missing corner."""
    zero = F.lit(0.0)

    def inside(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v, zero), most.cast("double"))

    x0, x1 = inside(F.least(b["x0"], b["x1"]), width), inside(F.greatest(b["x0"], b["x1"]), width)
    y0, y1 = inside(F.least(b["y0"], b["y1"]), height), inside(F.greatest(b["y0"], b["y1"]), height)
    whole = b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull()
    return F.when(whole & (x1 - x0 > LEAST_SIDE) & (y1 - y0 > LEAST_SIDE), box(x0, y0, x1, y1))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def share_inside(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``; 0 for an ``a`` without area."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def resized(width: Column, height: Column, longest: int = 1600) -> Column:
    """Sides of an image whose longer one is at most ``longest``."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * scale)).cast("int").alias("height"))
