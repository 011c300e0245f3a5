"""Geometry and rounding columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Share of the shorter box that must overlap, gap in character widths that
# makes a space, shorter image side after enlarging, largest enlargement and its stand-in.
LINE_OVERLAP = 0.4
SPACE_GAP_RATIO = 0.35
MIN_SHORT_SIDE = 640
MAX_SCALE = 2.2
CAPPED_SCALE = 2.0


def rect(points: Column, scale: Column) -> Column:
    """P1. Axis-aligned rectangle of a polygon, in pixels of the original image. Dividing by the
    positive scale keeps the order, so it is done once, after the extremes are taken."""

    def side(pick, axis: str) -> Column:
        return pick(points[axis]).cast("double") / scale

    return F.struct(
        side(F.array_min, "x").alias("x0"),
        side(F.array_min, "y").alias("y0"),
        side(F.array_max, "x").alias("x1"),
        side(F.array_max, "y").alias("y1"),
    )


def percent(confidence: Column) -> Column:
    """P3."""
    return confidence * F.lit(100.0)


def vertical_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """J1. Overlap as a share of the shorter box; 0 when that box has no height."""
    shorter = F.least(a1 - a0, b1 - b0)
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(shorter > 0, overlap / shorter).otherwise(F.lit(0.0))


def drawable(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """P5."""
    return F.coalesce((x1 > x0) & (y1 > y0), F.lit(False))


def round_up_half(value: Column) -> Column:
    """F14. Halves go towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def rounded(value: Column, digits: int) -> Column:
    """``round``, halves away from zero, which goes by way of a decimal number. Where that cannot make
    a difference (no half nearby, whole part exact) the nearest multiple is taken at once."""
    scale = F.lit(10.0**digits)
    scaled = value * scale
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.01) & (F.abs(scaled) > 0.6)
    return F.when(plain, F.rint(scaled) / scale).otherwise(F.round(value, digits))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """F13. BT.601 luma, 0..255."""
    return round_up_half(
        F.lit(0.299) * red + F.lit(0.587) * green + F.lit(0.114) * blue
    ).cast("int")


def resize_scale(
    width: Column,
    height: Column,
    min_side: int = MIN_SHORT_SIDE,
    max_scale: float = MAX_SCALE,
    capped: float = CAPPED_SCALE,
) -> Column:
    """P11. Enlargement before recognition; boxes are divided by it afterwards."""
    short = F.least(width, height)
    wanted = F.lit(float(min_side)) / F.when(short > 0, short)
    return (
        F.when((short >= min_side) | (short == 0), F.lit(1.0))
        .when(wanted > max_scale, F.lit(capped))
        .otherwise(wanted)
    )


def resized(side: Column, scale: Column) -> Column:
    """P11. New side, half to even."""
    return F.bround(side * scale, 0).cast("int")
