"""Checks of placements against pages: every check gives issue rows, ``issues.gate`` decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import settled
from ..functions import geometry as G
from ..settings import EPSILON, SHEET_HEIGHT_MM, SHEET_WIDTH_MM
from .issues import issue

#: Cells that rectangles are dealt to, so that only neighbours are compared.
CELL_MM = 70.0
#: Rectangles of a page up to which all are compared; their cells would be more rows than their pairs.
FEW = 16


def _shown(page: Column) -> Column:
    return F.when(page >= 0, page + 1)


def overlaps(placements: DataFrame, *keys: str, cell: float = CELL_MM, few: int = FEW) -> DataFrame:
    """(keys, first_id, second_id) of rectangles that overlap on one page, each pair once.

    Needs id, x, y, w, h. Those of a page of few are compared all with all. On a page
    of many, rectangles are joined by equality of page and grid cell; a pair counts in
    the cell that holds the upper left corner of what both cover.
    """
    finite = reduce(lambda a, b: a & b, [G.finite(F.col(c)) for c in ("x", "y", "w", "h")])
    sound = placements.where(finite & (F.col("w") > 0) & (F.col("h") > 0)).select(*keys, F.struct("id", "x", "y", "w", "h").alias("r"))
    counted = sound.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)) if few else F.lit(1))
    cells = lambda low, size: F.sequence(F.floor(low / cell), F.floor((low + size) / cell))
    dealt = counted.where(F.col("__n") > few).select(*keys, "r", F.explode(cells(F.col("r.x"), F.col("r.w"))).alias("__cx"))
    dealt = dealt.select(*keys, "r", "__cx", F.explode(cells(F.col("r.y"), F.col("r.h"))).alias("__cy"))
    here = (F.col("__cx") == F.floor(F.greatest("a.x", "b.x") / cell)) & (F.col("__cy") == F.floor(F.greatest("a.y", "b.y") / cell))
    sparse = counted.where((F.col("__n") > 1) & (F.col("__n") <= few)).select(*keys, "r")

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        both = rows.withColumnRenamed("r", "a").join(rows.withColumnRenamed("r", "b"), on)
        return both.where((F.col("a.id") < F.col("b.id")) & G.overlap(F.col("a"), F.col("b")))

    named = [*keys, F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id")]
    far = met(dealt, [*keys, "__cx", "__cy"]).where(here).select(*named)
    if not few:  # small rectangles lie in few cells: no count of a page is worth its memory
        return far
    return met(sparse, list(keys)).select(*named).unionByName(far)


def duplicates(placements: DataFrame) -> DataFrame:
    """An issue for every placement of a page but the first, with its own output page; equal ones count as often as they occur."""
    counted = placements.groupBy("batch_id", "page_id", "output_page").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("batch_id", "page_id").orderBy("output_page")) == 1
    repeated = counted.select("batch_id", "page_id", "output_page", (F.col("n") - F.when(first, 1).otherwise(0)).alias("n")).where("n > 0")
    repeated = repeated.select("batch_id", "page_id", "output_page", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return repeated.select(*issue(F.col("batch_id"), "placement_duplicate", F.array("page_id"), _shown(F.col("output_page"))))


def page_gaps(placements: DataFrame) -> DataFrame:
    """An issue for each batch whose page numbers aren't 0 to the last one."""
    used = placements.where("output_page >= 0").groupBy("batch_id", "output_page").agg(F.lit(1).alias("one"))
    spans = used.groupBy("batch_id").agg(F.max("output_page").alias("last"), F.count("*").alias("n"))
    return spans.where("last + 1 <> n").select(*issue(F.col("batch_id"), "placement_page_gap", F.array()))


def invalid(placements: DataFrame) -> Column:
    """Page or geometry that can't be: later checks skip such a row."""
    numbers = reduce(lambda a, b: a & b, [G.finite(F.col(c)) for c in ("x", "y", "width", "height")])
    fine = numbers & (F.col("output_page") >= 0) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("width") > 0) & (F.col("height") > 0)
    return ~F.coalesce(fine, F.lit(False))


def placement_issues(placements: DataFrame, assets: DataFrame) -> DataFrame:
    """Issues of placements (batch_id, page_id, output_page, x, y, width, height, crop) against assets (width_pt, height_pt)."""
    sizes = assets.select("batch_id", "page_id", "width_pt", "height_pt", F.lit(True).alias("__known")).distinct()
    # Read three times: placements with their assets, and either without the other.
    both = settled(placements.withColumn("__placed", F.lit(True)).join(sizes, ["batch_id", "page_id"], "full"))
    placed = both.where("__placed").withColumn("__bad", invalid(both))
    ids, page = F.array("page_id"), _shown(F.col("output_page"))
    clipped = ~G.on_sheet(F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    source = F.col("width_pt") * G.width(F.col("crop")) / (F.col("height_pt") * G.height(F.col("crop")))
    skewed = ~G.close(source, F.col("width") / F.col("height"))
    codes = (
        F.when(F.col("__known").isNull(), F.array(F.lit("placement_unknown_asset")))
        .when(F.col("__bad"), F.array(F.lit("placement_invalid")))
        .otherwise(F.array_compact(F.array(F.when(clipped, "placement_clipped"), F.when(skewed, "placement_aspect_mismatch"))))
    )
    single = placed.select("*", F.explode(codes).alias("__code")).select(*issue(F.col("batch_id"), F.col("__code"), ids, page))
    missing = both.where("__placed IS NULL").select("batch_id", "page_id").distinct().select(*issue(F.col("batch_id"), "placement_missing", ids))
    boxes = placed.where("__known AND NOT __bad").select("batch_id", "output_page", F.col("page_id").alias("id"), "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))
    crossing = overlaps(boxes, "batch_id", "output_page").select(
        *issue(F.col("batch_id"), "placement_overlap", F.array("first_id", "second_id"), _shown(F.col("output_page")))
    )
    return reduce(DataFrame.unionByName, [duplicates(placements), single, crossing, missing, page_gaps(placements)])


def asset_issues(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """Assets named twice, and assets whose id isn't that of their page."""
    twice = assets.groupBy("batch_id", "page_id").agg(F.count("*").alias("n")).where("n > 1")
    lost = assets.join(pages.select("batch_id", "page_id"), ["batch_id", "page_id"], "left_anti")
    return twice.select(*issue(F.col("batch_id"), "asset_duplicate", F.array("page_id"))).unionByName(
        lost.select(*issue(F.col("batch_id"), "asset_mapping_mismatch", F.array("page_id")))
    )


def document_issues(documents: DataFrame, pages: DataFrame, tolerance_pt: float = 0.75) -> DataFrame:
    """Issues of a composed document and of its pages.

    ``documents``: batch_id, readable, encrypted, expected_pages; ``pages``: batch_id,
    page (from 1), media and crop (boxes in points), rotation, n_annotations. An
    unreadable, an encrypted and an empty document have that one issue. Null counts as
    unreadable, as not encrypted, and as a page that isn't A4.
    """
    counted = documents.join(pages.groupBy("batch_id").agg(F.count("*").alias("__n")), "batch_id", "left").fillna(0, ["__n"])
    code = (
        F.when(~F.coalesce("readable", F.lit(False)), "pdf_unreadable")
        .when(F.col("encrypted"), "pdf_encrypted")
        .when(F.col("__n") == 0, "pdf_empty")
        .when(F.col("__n") != F.col("expected_pages"), "pdf_page_count")
    )
    judged = counted.withColumn("__code", code)
    whole = judged.where("__code IS NOT NULL").select(*issue(F.col("batch_id"), F.col("__code"), F.array()))
    legible = judged.where(F.coalesce("__code", F.lit("pdf_page_count")) == "pdf_page_count").select("batch_id")
    m, c = F.col("media"), F.col("crop")
    sheet = (F.pmod("rotation", F.lit(360)) == 0) & reduce(
        lambda a, b: a & b,
        [F.abs(m[high] - m[low] - mm * G.MM_TO_POINT) <= tolerance_pt for high, low, mm in (("x1", "x0", SHEET_WIDTH_MM), ("y1", "y0", SHEET_HEIGHT_MM))],
    )
    clipped = reduce(lambda a, b: a | b, [c[n] > m[n] + tolerance_pt for n in ("x0", "y0")] + [c[n] < m[n] - tolerance_pt for n in ("x1", "y1")])
    codes = F.array(
        F.when(F.col("n_annotations") > 0, "pdf_annotations"),
        F.when(~F.coalesce(sheet, F.lit(False)), "pdf_non_a4"),
        F.when(clipped, "pdf_page_clipped"),
    )
    told = pages.join(legible, "batch_id", "left_semi").select("batch_id", "page", F.explode(F.array_compact(codes)).alias("__code"))
    return whole.unionByName(told.select(*issue(F.col("batch_id"), F.col("__code"), F.array(), F.col("page"))))


def render_issues(renders: DataFrame, dpi: int, tolerance_px: int = 2) -> DataFrame:
    """Issues of rendered pages: batch_id, page (from 1), state (ok, missing or failed), pixel_width, pixel_height.

    A page without a state or a size counts as failed.
    """
    sides = (("pixel_width", SHEET_WIDTH_MM), ("pixel_height", SHEET_HEIGHT_MM))
    off = reduce(lambda a, b: a | b, [F.abs(F.col(c) - G.expected_pixels(F.lit(mm), dpi)) > tolerance_px for c, mm in sides])
    code = (
        F.when(F.col("state") == "missing", "renderer_missing")
        .when(~F.coalesce(F.col("state") == "ok", F.lit(False)) | off.isNull(), "renderer_failed")
        .when(off, "render_size_mismatch")
    )
    return renders.withColumn("__code", code).where("__code IS NOT NULL").select(
        *issue(F.col("batch_id"), F.col("__code"), F.array(), F.col("page"))
    )


def source_issues(assets: DataFrame, found: DataFrame, tolerance_pt: float = 0.01) -> DataFrame:
    """Assets whose file isn't one readable page of the size that is on record.

    ``assets``: batch_id, page_id, width_pt, height_pt; ``found``: batch_id, page_id,
    readable, encrypted, n_pages, found_width, found_height. No row found is an issue.
    """
    both = assets.select("batch_id", "page_id", "width_pt", "height_pt").join(found, ["batch_id", "page_id"], "left")
    fine = F.col("readable") & ~F.coalesce("encrypted", F.lit(False)) & (F.col("n_pages") == 1)
    for known, seen in (("width_pt", "found_width"), ("height_pt", "found_height")):
        a, b = F.col(known), F.col(seen)
        fine = fine & G.finite(b) & (b > 0) & (F.abs(a - b) <= F.greatest(F.lit(tolerance_pt), 1e-9 * F.greatest(F.abs(a), F.abs(b))))
    return both.where(~F.coalesce(fine, F.lit(False))).select(*issue(F.col("batch_id"), "source_asset_invalid", F.array("page_id")))


def compose_errors(placements: DataFrame, assets: DataFrame) -> DataFrame:
    """(batch_id, seq, page_id, error) of each batch that can't be composed: the first placement, by ``seq``, that is at fault.

    ``placements``: batch_id, seq (of one placement each), page_id, output_page, x, y, width, height, crop;
    ``assets``: batch_id, page_id (each once), width_pt, height_pt. Only what comes
    before a fault decides, so overlaps with later placements don't matter. A batch
    whose placements are all fine may still lack a page: then seq and page_id are null.
    """
    known = assets.select("batch_id", "page_id", "width_pt", "height_pt", F.lit(True).alias("__known"))
    rows = placements.join(known, ["batch_id", "page_id"], "left")
    again = F.row_number().over(Window.partitionBy("batch_id", "page_id").orderBy("seq")) > 1
    numbers = reduce(lambda a, b: a & b, [G.finite(F.col(c)) for c in ("x", "y", "width", "height")])
    origin = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("width") > 0) & (F.col("height") > 0)
    source = F.col("width_pt") * G.width(F.col("crop")) / (F.col("height_pt") * G.height(F.col("crop")))
    boxes = placements.select("batch_id", "output_page", F.col("seq").alias("id"), "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))
    hit = overlaps(boxes, "batch_id", "output_page", few=0).select("batch_id", F.col("second_id").alias("seq"), F.lit(True).alias("__hit")).distinct()
    error = (
        F.when(again, "duplicate")
        .when(F.col("__known").isNull(), "missing_asset")
        .when(~F.coalesce(F.col("output_page") >= 0, F.lit(False)), "negative_page")
        .when(~numbers, "not_finite")
        .when(~origin, "bad_geometry")
        .when(~G.on_sheet(F.col("x"), F.col("y"), F.col("width"), F.col("height")), "off_sheet")
        .when(~F.coalesce(G.close(source, F.col("width") / F.col("height")), F.lit(False)), "aspect_mismatch")
        .when(F.col("__hit"), "overlap")
    )
    judged = rows.join(hit, ["batch_id", "seq"], "left").select("batch_id", "seq", "page_id", error.alias("error"))
    first = judged.where("error IS NOT NULL").groupBy("batch_id").agg(F.min(F.struct("seq", "page_id", "error")).alias("f"))
    first = first.select("batch_id", "f.seq", "f.page_id", "f.error")
    gaps = page_gaps(placements).select("batch_id").join(first, "batch_id", "left_anti")
    return first.unionByName(gaps.select("batch_id", F.lit("page_gap").alias("error")), allowMissingColumns=True)


def low_resolution(placements: DataFrame, dpi: int) -> DataFrame:
    """Placements drawn larger than their pixels allow: soft; without pixels to tell: hard."""
    actual = F.greatest(
        F.col("width") / (F.col("width_pt") * G.width(F.col("crop"))), F.col("height") / (F.col("height_pt") * G.height(F.col("crop")))
    )
    code = F.when(F.col("raster_scale").isNull() & F.col("is_raster"), "source_resolution_unverifiable").when(
        300 * F.col("raster_scale") / actual + EPSILON < dpi, "low_source_resolution"
    )
    return placements.withColumn("__code", code).where("__code IS NOT NULL").select(
        *issue(F.col("batch_id"), F.col("__code"), F.array("page_id"), _shown(F.col("output_page")))
    )
