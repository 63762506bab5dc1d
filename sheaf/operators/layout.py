"""Physical sizes, next-fit packing onto sheets, and placement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..settings import EPSILON, MIN_QR_MM, MIN_TEXT_MM, MM_PER_INCH, POINTS_PER_INCH, SHEET_WIDTH_MM, Settings
from ..shipping import ship
from .blocks import in_blocks, spans

STEPS = 64


def raster_limit(pixels: Column, points: Column, dpi: int) -> Column:
    """Millimetres a point at which drawn pixels still have the resolution."""
    return pixels * MM_PER_INCH / (dpi * points)


def size_bounds(items: DataFrame, settings: Settings) -> DataFrame:
    """``items`` with ratio, min_width, min_height, max_width, max_height (mm) and a status.

    Needs width_pt, height_pt, crop, text_boxes, qr_boxes and raster_scale (mm a point,
    null without a raster). Status: ok, outside_crop, infeasible.
    """
    crop_w, crop_h = G.width(F.col("crop")), G.height(F.col("crop"))
    w_pt, h_pt = F.col("width_pt") * crop_w, F.col("height_pt") * crop_h
    ratio = w_pt / h_pt
    text = F.transform("text_boxes", lambda b: MIN_TEXT_MM / (G.height(b) / crop_h))
    code = F.transform("qr_boxes", lambda b: F.greatest(MIN_QR_MM / (G.height(b) / crop_h), MIN_QR_MM / (G.width(b) / crop_w) / ratio))
    detected = F.concat(text, code)
    usable_w, usable_h = F.lit(settings.usable_width), F.lit(settings.usable_height)
    natural_w, natural_h = w_pt / POINTS_PER_INCH * MM_PER_INCH, h_pt / POINTS_PER_INCH * MM_PER_INCH
    fit = F.least(F.lit(1.0), usable_w / natural_w, usable_h / natural_h)
    boxed = F.size(detected) > 0
    out = items.withColumns(
        {
            "ratio": ratio,
            "min_height": F.when(boxed, F.array_max(detected)).otherwise(natural_h * fit),
            "min_width": F.when(boxed, F.array_max(detected) * ratio).otherwise(natural_w * fit),
            "max_height": F.least(usable_h, usable_w / ratio, h_pt * F.col("raster_scale")),
        }
    ).withColumn("max_width", F.col("max_height") * F.col("ratio"))
    safe = F.forall(F.concat("text_boxes", "qr_boxes"), lambda b: G.inside(b, F.col("crop")))
    feasible = (
        (F.col("min_width") <= F.least(usable_w, F.col("max_width")) + EPSILON)
        & (F.col("min_height") <= F.least(usable_h, F.col("max_height")) + EPSILON)
    )
    return out.withColumn("status", F.when(~safe, "outside_crop").when(~feasible, "infeasible").otherwise("ok"))


def next_fit(groups: list[list[float]], usable: float, gap: float) -> list[list[int]]:
    """Output page of every item, groups in order, heights in mm.

    A group stays together where a page can hold it. One that no page can hold starts
    a page, goes on over as many as it takes, and closes the last one.
    """
    pages, page, used = [], -1, None  # used: height taken on the open page, None without one

    def fits(heights: list[float]) -> bool:
        return sum(heights) + gap * (len(heights) - 1) <= usable + EPSILON

    held: list[float] = []
    for heights in groups:
        if fits(heights):
            if used is None or not fits(held + heights):
                page, held = page + 1, []
            held = held + heights
            used = True
            pages.append([page] * len(heights))
            continue
        places, held = [], []
        page += 1
        for h in heights:
            if not fits([h]):
                raise ValueError("an item is higher than a page")
            if held and not fits([*held, h]):
                page, held = page + 1, []
            held.append(h)
            places.append(page)
        used, held = None, []
        pages.append(places)
    return pages


def pack(items: DataFrame, settings: Settings, carry: tuple[str, ...] = ()) -> DataFrame:
    """``items`` (batch_id, group_seq, item_seq, page_id, min_height, and columns to ``carry``) with output_page, from 0.

    Next-fit is sequential, so a batch's items, without their contents, meet in one
    task, which packs one batch after the other; tasks run side by side.
    """
    usable, gap = settings.usable_height, settings.item_gap_mm

    def run(rows: pa.Table) -> pa.Table:
        groups, heights, pages = rows.column("group_seq").to_pylist(), rows.column("min_height").to_pylist(), []
        for start, end in spans(rows, ["batch_id"]):
            parts, last = [], None
            for g, h in zip(groups[start:end], heights[start:end], strict=True):
                if not parts or g != last:
                    parts.append([])
                parts[-1].append(h)
                last = g
            pages += [p for places in next_fit(parts, usable, gap) for p in places]
        return rows.append_column("output_page", pa.array(pages, "int32"))

    slim = items.select("batch_id", "group_seq", "item_seq", "page_id", F.col("min_height").cast("double").alias("min_height"), *carry)
    schema = slim.select("*", F.lit(0).cast("int").alias("output_page")).schema
    return in_blocks(slim, ["batch_id"], ["group_seq", "item_seq"], run, schema)


def common_widths(items: pa.Array, settings: Settings) -> np.ndarray:
    """For each page the greatest common width, by bisection, at which its items fit below each other.

    ``items``: a page's structs of min_width, max_width and ratio, summed in their
    order. All pages are halved together, the first items of each, then the second ones.
    """
    usable, counts = settings.usable_width, items.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    sizes, starts = items.flatten(), np.cumsum(counts) - counts
    low, high, ratio = (sizes.field(c).to_numpy(zero_copy_only=False) for c in ("min_width", "max_width", "ratio"))
    high = np.fmin(high, usable)
    ranks = []
    for k in range(counts.max(initial=0)):
        pages = np.flatnonzero(counts > k)
        at = starts[pages] + k
        ranks.append((pages, low[at], high[at], ratio[at]))
    available = settings.usable_height - settings.item_gap_mm * np.maximum(counts - 1, 0)

    def total(width: np.ndarray) -> np.ndarray:
        height = np.zeros(len(counts))
        for pages, a, b, r in ranks:
            height[pages] += np.fmax(a, np.fmin(width[pages], b)) / r
        return height

    lo, hi = np.zeros(len(counts)), np.full(len(counts), usable)
    for _ in range(STEPS):
        middle = (lo + hi) / 2
        fits = total(middle) <= available
        lo, hi = np.where(fits, middle, lo), np.where(fits, hi, middle)
    return np.where(total(np.zeros(len(counts))) <= available + EPSILON, lo, 0.0)


def target_width(items: Column, settings: Settings) -> Column:
    """``common_widths`` of a column."""
    ship()

    @F.arrow_udf("double")
    def widths(pages: pa.Array) -> pa.Array:
        return pa.array(common_widths(pages, settings))

    return widths(items)


def place(packed: DataFrame, settings: Settings, carry: tuple[str, ...] = ()) -> DataFrame:
    """(batch_id, output_page, page_id, x, y, width, height) in mm from the sheet's top left corner, and columns to ``carry``.

    Needs min_width, max_width and ratio beside what ``pack`` returns. The items of
    a page, as many as fit one, are gathered for the common width and dealt out again;
    the rest is windows over a page.
    """
    page = ["batch_id", "output_page"]
    needed = ["group_seq", "item_seq", "min_width", "max_width", "ratio"]
    rest = [c for c in dict.fromkeys(["page_id", *carry]) if c not in needed]
    gathered = F.sort_array(F.collect_list(F.struct(*needed[:2], F.struct(*needed[2:]).alias("size"), F.struct(*rest).alias("rest"))))
    common = packed.groupBy(*page).agg(gathered.alias("__items"))
    common = common.withColumn("__target", target_width(F.transform("__items", lambda x: x["size"]), settings))
    sized = common.select(*page, "__target", F.explode("__items").alias("__item"))
    sized = sized.select(*page, "__target", "__item.group_seq", "__item.item_seq", "__item.size.*", "__item.rest.*")
    width = F.greatest("min_width", F.least("__target", "max_width", F.lit(settings.usable_width)))
    sized = sized.withColumn("width", width).withColumn("height", F.col("width") / F.col("ratio"))
    order = Window.partitionBy(*page).orderBy("group_seq", "item_seq")
    gap = F.lit(settings.item_gap_mm)
    above = F.coalesce(F.sum(F.col("height") + gap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everything = F.sum(F.col("height") + gap).over(Window.partitionBy(*page)) - gap
    top = F.lit(settings.page_margin_mm) + (F.lit(settings.usable_height) - everything) / 2
    return sized.select(*page, "page_id", ((SHEET_WIDTH_MM - F.col("width")) / 2).alias("x"), (top + above).alias("y"), "width", "height", *carry)
