"""Column expressions over boxes and placements. A box is a struct x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import EPSILON, MM_PER_INCH, POINTS_PER_INCH, SHEET_HEIGHT_MM, SHEET_WIDTH_MM

PADDING = 0.01
MM_TO_POINT = POINTS_PER_INCH / MM_PER_INCH


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.lit(v).cast("double").alias(n) if not isinstance(v, Column) else v.cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])


def width(b: Column) -> Column:
    return F.round(b["x1"] - b["x0"], 10)


def height(b: Column) -> Column:
    return F.round(b["y1"] - b["y0"], 10)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def close(a: Column, b: Column, tolerance: float = EPSILON) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))


def displayed(w: Column, h: Column, rotation: Column) -> tuple[Column, Column]:
    turned = F.pmod(rotation, F.lit(360)).isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def inside(inner: Column, outer: Column) -> Column:
    return (
        (inner["x0"] >= outer["x0"] - EPSILON)
        & (inner["y0"] >= outer["y0"] - EPSILON)
        & (inner["x1"] <= outer["x1"] + EPSILON)
        & (inner["y1"] <= outer["y1"] + EPSILON)
    )


def protected_valid(boxes: Column) -> Column:
    """Every box is finite, ordered, and further than the padding from each edge."""

    def fine(b: Column) -> Column:
        ordered = (b["x0"] < b["x1"]) & (b["y0"] < b["y1"])
        clear = (b["x0"] > PADDING) & (b["y0"] > PADDING) & (b["x1"] < 1 - PADDING) & (b["y1"] < 1 - PADDING)
        return F.coalesce(finite(b["x0"]) & finite(b["y0"]) & finite(b["x1"]) & finite(b["y1"]) & ordered & clear, F.lit(False))

    return F.forall(boxes, fine)


def with_protected(crop: Column, boxes: Column) -> Column:
    """The crop widened to hold every box and its padding."""
    low = lambda n: F.round(F.least(crop[n], F.array_min(F.transform(boxes, lambda b: b[n] - PADDING))), 10)
    high = lambda n: F.round(F.greatest(crop[n], F.array_max(F.transform(boxes, lambda b: b[n] + PADDING))), 10)
    return F.when(F.size(boxes) == 0, crop).otherwise(box(low("x0"), low("y0"), high("x1"), high("y1")))


def on_sheet(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x + w <= SHEET_WIDTH_MM + EPSILON) & (y + h <= SHEET_HEIGHT_MM + EPSILON)


def overlap(a: Column, b: Column) -> Column:
    """Whether two structs with x, y, w, h share more than the tolerance in both directions."""
    across = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    down = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return (across > EPSILON) & (down > EPSILON)


def page_transform(x: Column, y: Column, w: Column, h: Column, crop_left: Column, crop_bottom: Column, crop_right: Column) -> Column:
    """Scale and shift from source points to sheet points, whose y axis points up."""
    scale = w * MM_TO_POINT / (crop_right - crop_left)
    return F.struct(
        scale.alias("scale"),
        (x * MM_TO_POINT - scale * crop_left).alias("tx"),
        ((SHEET_HEIGHT_MM - y - h) * MM_TO_POINT - scale * crop_bottom).alias("ty"),
    )


def expected_pixels(mm: Column, dpi: int) -> Column:
    """Rendered size in pixels, half to even."""
    return F.bround(mm / MM_PER_INCH * dpi).cast("int")
