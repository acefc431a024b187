"""Bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(value: Column) -> Column:
    # NaN sorts above everything and equals itself in Spark, so test it by name.
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def bbox_is_valid(box: Column) -> Column:
    """True for a null box, or four finite numbers that are ordered and inside the unit page."""
    x1, y1, x2, y2 = (box[name] for name in ("x1", "y1", "x2", "y2"))
    inside = (x1 >= 0) & (x1 < x2) & (x2 <= 1) & (y1 >= 0) & (y1 < y2) & (y2 <= 1)
    finite = _finite(x1) & _finite(y1) & _finite(x2) & _finite(y2)
    return box.isNull() | F.coalesce(finite & inside, F.lit(False))


def normalise_bbox(box: Column, width: Column, height: Column) -> Column:
    """Absolute page coordinates to fractions of the page."""
    return F.struct(
        (box["x1"] / width).alias("x1"),
        (box["y1"] / height).alias("y1"),
        (box["x2"] / width).alias("x2"),
        (box["y2"] / height).alias("y2"),
    )
