"""Crop decisions from pixel statistics, and tile differences of rendered pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..shipping import ship

#: Share of background, its distance, deviation and range, least confidence.
SHARE, DISTANCE, DEVIATION, RANGE, CONFIDENCE = 0.98, 10, 4.0, 4, 0.65
TILE = 32
RESULT = "x0 double, y0 double, x1 double, y1 double, code string"


def region_stats(pixels: DataFrame, *keys: str, distance: float = DISTANCE) -> DataFrame:
    """Median, population deviation, range and share near the median of ``value`` for each key (page, region, channel)."""
    middle = pixels.groupBy(*keys).agg(F.median("value").alias("median"))
    joined = pixels.join(middle, list(keys))
    return joined.groupBy(*keys).agg(
        F.first("median").alias("median"),
        F.stddev_pop("value").alias("deviation"),
        (F.max("value") - F.min("value")).alias("range"),
        F.avg((F.abs(F.col("value") - F.col("median")) <= distance).cast("double")).alias("share"),
    )


def _plain(region: np.ndarray, background: np.ndarray) -> bool:
    flat = region.reshape(-1, 3).astype(np.int64)
    if not len(flat):
        return False
    near = np.abs(flat - background).max(axis=1) <= DISTANCE
    return bool(near.mean() >= SHARE and flat.std(axis=0).max() <= DEVIATION and np.ptp(flat, axis=0).max() <= RANGE)


def content_box(image: np.ndarray) -> tuple[float, float, float, float] | None:
    """The crop of an image (height, width, 3) on an even background; null where that isn't certain."""
    h, w, _ = image.shape
    if min(h, w) < 3:
        return None
    side = max(1, min(5, w // 50, h // 50))
    ends = (slice(0, side), slice(-side, None))
    corners = np.concatenate([image[a, b].reshape(-1, 3) for a in ends for b in ends])
    background = np.trunc(np.median(corners, axis=0)).astype(np.int64)
    edges = (image[0], image[:, -1], image[-1], image[:, 0])
    if not all(_plain(r, background) for r in (corners, *edges)):
        return None
    content = np.abs(image.astype(np.int64) - background).max(axis=2) > DISTANCE
    ys, xs = np.flatnonzero(content.any(axis=1)), np.flatnonzero(content.any(axis=0))
    if not len(xs) or xs[0] == 0 or ys[0] == 0 or xs[-1] == w - 1 or ys[-1] == h - 1:
        return None
    found = (xs[0] - 1) / w, (ys[0] - 1) / h, (xs[-1] + 2) / w, (ys[-1] + 2) / h
    return tuple(round(float(v), 10) for v in found) if found[0] > 0 and found[1] > 0 and found[2] < 1 and found[3] < 1 else None


def margins_plain(image: np.ndarray, crop: tuple[float, float, float, float]) -> bool:
    """Whether all that a crop removes is background."""
    h, w, _ = image.shape
    left, top = int(np.floor(crop[0] * w + 1e-9)), int(np.floor(crop[1] * h + 1e-9))
    right, bottom = int(np.ceil(crop[2] * w - 1e-9)), int(np.ceil(crop[3] * h - 1e-9))
    if left <= 0 or top <= 0 or right >= w or bottom >= h:
        return False
    side = max(1, min(5, w // 50, h // 50))
    ends = (slice(0, side), slice(-side, None))
    corners = np.concatenate([image[a, b].reshape(-1, 3) for a in ends for b in ends])
    background = np.trunc(np.median(corners, axis=0)).astype(np.int64)
    return all(_plain(r, background) for r in (image[:, :left], image[:, right:], image[:top], image[bottom:]))


def decide(image: np.ndarray | None, boxes: list[tuple[float, float, float, float]]) -> tuple[float, float, float, float, str | None]:
    """A crop that holds the protected boxes, or the whole page and why."""
    if image is None or image.ndim != 3 or image.shape[2] != 3 or min(image.shape[:2]) < 3:
        return 0.0, 0.0, 1.0, 1.0, "crop_preview_invalid"
    found = content_box(image)
    if found is not None and boxes:
        b = np.array(boxes)
        low, high = b[:, :2].min(axis=0) - G.PADDING, b[:, 2:].max(axis=0) + G.PADDING
        found = tuple(round(float(v), 10) for v in (*np.minimum(found[:2], low), *np.maximum(found[2:], high)))
    if found is None or not margins_plain(image, found):
        return 0.0, 0.0, 1.0, 1.0, "crop_uncertain"
    return (*found, None)


def choose_crops(pages: DataFrame) -> DataFrame:
    """(batch_id, page_id, crop, code) of pages with pixels (RGB bytes), pixel_width, pixel_height, document_type, confidence and boxes.

    Type, confidence and boxes are tried in the JVM; only pages that pass have their
    pixels sent to the Arrow function.
    """
    early = (
        F.when(F.col("document_type") == "physical_ticket_photo", "crop_physical_ticket_photo")
        .when(F.coalesce(F.col("confidence"), F.lit(0.0)) < CONFIDENCE, "crop_low_observation_confidence")
        .when(~G.protected_valid(F.col("boxes")), "crop_protected_region_unsafe")
    )
    ship(pages.sparkSession)
    judged = pages.withColumn("__early", early)
    full = G.box(0, 0, 1, 1)
    refused = judged.where("__early IS NOT NULL").select("batch_id", "page_id", full.alias("crop"), F.col("__early").alias("code"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                size = int(r.pixel_width or 0) * int(r.pixel_height or 0) * 3
                good = r.pixels is not None and size > 0 and len(r.pixels) == size
                image = np.frombuffer(r.pixels, np.uint8).reshape(int(r.pixel_height), int(r.pixel_width), 3) if good else None
                boxes = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r.boxes]
                rows.append((r.batch_id, r.page_id, *decide(image, boxes)))
            yield pd.DataFrame(rows, columns=["batch_id", "page_id", "x0", "y0", "x1", "y1", "code"])

    kept = judged.where("__early IS NULL").select("batch_id", "page_id", "pixels", "pixel_width", "pixel_height", "boxes")
    found = kept.mapInPandas(run, f"batch_id string, page_id string, {RESULT}")
    found = found.select("batch_id", "page_id", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("crop"), "code")
    return refused.unionByName(found)


def tile_difference(pixels: DataFrame, *keys: str, tile: int = TILE, strong: float = 32.0) -> DataFrame:
    """Mean difference, greatest tile mean and greatest share of strong pixels of a tile, from x, y and ``diff``."""
    tiles = pixels.groupBy(*keys, F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty")).agg(
        F.sum("diff").alias("s"), F.count("*").alias("n"), F.avg("diff").alias("m"), F.avg((F.col("diff") >= strong).cast("double")).alias("p")
    )
    return tiles.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("mean_diff"), F.max("m").alias("local_mean"), F.max("p").alias("local_strong")
    )


def ink_share(histogram: Column, threshold: int = 245) -> Column:
    """Share of pixels darker than a threshold, from a histogram of 256 counts."""
    dark = F.aggregate(F.slice(histogram, 1, threshold), F.lit(0).cast("long"), lambda a, n: a + n)
    return dark / F.aggregate(histogram, F.lit(0).cast("long"), lambda a, n: a + n)
