"""Boxes and affine matrices as column expressions on flat x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in "xywh")


def union_box(prefix: str = "") -> list[Column]:
    """Aggregates: the box around a group's boxes; an empty group gives a zero box."""
    x, y, w, h = box(prefix)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [zero(F.min(x)).alias("x"), zero(F.min(y)).alias("y"), zero(F.max(x + w) - F.min(x)).alias("w"), zero(F.max(y + h) - F.min(y)).alias("h")]


def overlaps(a: Box, b: Box) -> Column:
    """Strict overlap: touching boxes do not overlap."""
    return (a[0] < b[0] + b[2]) & (b[0] < a[0] + a[2]) & (a[1] < b[1] + b[3]) & (b[1] < a[1] + a[3])


def shared_area(a: Box, b: Box) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def coverage(inner: Box, outer: Box) -> Column:
    """Share of inner's area within outer, 0 for a degenerate inner."""
    area = inner[2] * inner[3]
    return F.when(area > 0, shared_area(inner, outer) / area).otherwise(0.0)


def expanded(b: Box, pad: float) -> Box:
    return b[0] - pad, b[1] - pad, b[2] + 2 * pad, b[3] + 2 * pad


def clamped(b: Box, width: Column, height: Column) -> Box:
    x, y = F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0))
    return x, y, F.least(b[0] + b[2], width) - x, F.least(b[1] + b[3], height) - y


def inside_page(b: Box, width: Column, height: Column, margin: float = 2.0) -> Column:
    return (b[0] >= -margin) & (b[1] >= -margin) & (b[0] + b[2] <= width + margin) & (b[1] + b[3] <= height + margin)


def compose(m: list[Column], n: list[Column]) -> list[Column]:
    """m after n, for column vectors."""
    return [m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5]]


def transformed(m: list[Column], x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
    """The box around the four transformed corners."""
    xs = [m[0] * x + m[2] * y + m[4] for x in (x0, x1) for y in (y0, y1)]
    ys = [m[1] * x + m[3] * y + m[5] for x in (x0, x1) for y in (y0, y1)]
    return F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)


def turned(a: Column, b: Column, c: Column) -> Column:
    """Whether a run is turned or sheared by more than a twentieth of its scale; a run without a scale is not."""
    scale = F.hypot(a, b)
    return (scale > 0) & ((F.abs(b) > scale * 0.05) | (F.abs(c) > scale * 0.05))


#: A glyph box's height in sizes, and the most that a slice is enlarged.
GLYPH_BOX, LARGEST_SCALE = 1.15, 1.5


def font_size(tx: list[Column], height: Column, scale: float) -> Column:
    """Length of the composed matrix's second column; without one, the run's own height."""
    return F.coalesce(F.nullif(F.hypot(tx[2], tx[3]), F.lit(0.0)), height * scale)


def baseline(tx: list[Column]) -> Column:
    return tx[5]


def run_box(tx: list[Column], width: Column, height: Column, scale: float) -> Box:
    """A run's box: its top is a size above the baseline, its height that of a glyph box."""
    size = font_size(tx, height, scale)
    return tx[4], tx[5] - size, width * scale, size * GLYPH_BOX


def intersection(a: Box, b: Box) -> Column:
    """The common box as a struct; null where the boxes do not overlap."""
    x, y = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    w, h = F.least(a[0] + a[2], b[0] + b[2]) - x, F.least(a[1] + a[3], b[1] + b[3]) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def covered_columns(x: Column, w: Column, bounds: Column) -> Column:
    """Numbers of the columns, between neighbouring bounds, that a range of x overlaps."""
    numbers = F.sequence(F.lit(0), F.size(bounds) - 2)
    return F.filter(numbers, lambda k: (x < F.get(bounds, k + 1)) & (x + w > F.get(bounds, k)))


def centre_inside(b: Box, region: Box) -> Column:
    cx, cy = b[0] + b[2] / 2, b[1] + b[3] / 2
    return (cx >= region[0]) & (cx <= region[0] + region[2]) & (cy >= region[1]) & (cy <= region[1] + region[3])


def display_scale(width: Column, measure: float, formula: Column | None = None, font: Column | None = None) -> Column:
    """How far a slice is scaled to the measure; a formula takes the ratio of the fonts instead."""
    plain = F.least(F.lit(measure) / F.greatest(width, F.lit(1.0)), F.lit(LARGEST_SCALE))
    return plain if formula is None else F.when(formula, font).otherwise(plain)


def half(c: Column) -> Column:
    """Quantised to halves, rounding halves up."""
    return F.floor(2 * c + 0.5) / 2
