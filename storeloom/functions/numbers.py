"""Numeric functions: confidence bands, fixed decimals, progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least averages of the bands.
HIGH, MEDIUM = 0.82, 0.55


def confidence_band(average: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(average >= high, "HIGH").when(average >= medium, "MEDIUM").otherwise("LOW")


def three_decimals(x: Column) -> Column:
    """Three decimals by the exact binary value; for values below 1,000, which is no bound on confidences."""
    return F.replace(F.format_number(x, 3), F.lit(","), F.lit("")).cast("double")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def percentage(done: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(done / total * 1000) / 10).otherwise(0.0)


def eta_seconds(elapsed_ms: Column, done: Column, total: Column) -> Column:
    left = F.greatest(total - done, F.lit(0))
    return F.when(done > 0, half_up(elapsed_ms / done * left / 1000)).otherwise(0)


def valid_box(box: Column) -> Column:
    """A box of positive size within the unit square."""
    x, y, w, h = (box[c] for c in ("x", "y", "width", "height"))
    finite = F.lit(True)
    for v in (x, y, w, h):
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(finite & (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= 1) & (y + h <= 1), F.lit(False))
