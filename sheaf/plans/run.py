"""One run over batches: pages and observations to placements, issues and a verdict."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..durable import settled
from ..operators import integrity, issues, layout, linkage
from ..settings import Settings


class Outcome(NamedTuple):
    groups: DataFrame
    placements: DataFrame
    issues: DataFrame
    verdict: DataFrame


def observation_issues(pages: DataFrame) -> DataFrame:
    """What is told of a page before linkage; a page may have several."""
    kind = F.col("document_type")
    codes = F.array_compact(
        F.array(
            F.when(kind == "physical_ticket_photo", "physical_ticket_attach_original"),
            F.when(kind == "unknown", "unknown_document"),
            F.when((kind != "physical_ticket_photo") & (F.col("confidence") < linkage.MIN_CONFIDENCE), "low_observation_confidence"),
        )
    )
    return pages.select("batch_id", "page_id", F.explode(codes).alias("c")).select(*issues.issue(F.col("batch_id"), F.col("c"), F.array("page_id")))


def run(pages: DataFrame, settings: Settings, ascii_only: bool = False) -> Outcome:
    """``pages``: batch_id, page_id, the fields of an observation, width_pt, height_pt, crop, text_boxes, qr_boxes, raster_scale.

    Photos are left out before linkage. Items that can't be sized are issues and are
    not placed, which fails their batch.
    """
    # Each of these is read several times; settled, it is computed once and its plan stays short.
    pages = settled(pages)
    told = observation_issues(pages)
    open_ = pages.where("document_type <> 'physical_ticket_photo'")
    pairs = settled(linkage.contenders(open_, ascii_only))
    rejected = settled(linkage.rejections(pairs, told=linkage.supports(open_)))
    matched = settled(linkage.matches(pairs, rejected))
    grouped = settled(linkage.groups(open_, matched))
    lone = linkage.unmatched(open_, pairs, rejected, matched)
    lone_issues = lone.select(*issues.issue(F.col("batch_id"), F.col("code"), F.array("support_id"), texts=issues.LINK_TEXTS))
    numbered = grouped.withColumn("group_seq", F.row_number().over(Window.partitionBy("batch_id").orderBy("rank", "members")))
    listed = numbered.select("batch_id", "group_seq", F.posexplode(F.concat("primary_page_ids", "support_page_ids")).alias("item_seq", "page_id"))
    measured = open_.select("batch_id", "page_id", "width_pt", "height_pt", "crop", "text_boxes", "qr_boxes", "raster_scale")
    sized = layout.size_bounds(listed.join(measured, ["batch_id", "page_id"]), settings)
    sized = settled(sized.select("batch_id", "group_seq", "item_seq", "page_id", "min_height", "min_width", "max_width", "ratio", "crop", "status"))
    refused = sized.where("status <> 'ok'").select(*issues.issue(F.col("batch_id"), "source_asset_invalid", F.array("page_id")))
    fine = sized.where("status = 'ok'").withColumn("min_height", F.least("min_height", F.lit(settings.usable_height)))
    packed = layout.pack(fine, settings, carry=("min_width", "max_width", "ratio", "crop"))
    placements = settled(layout.place(packed, settings, carry=("crop",)))
    checked = integrity.placement_issues(placements, open_)
    everything = settled(told.unionByName(lone_issues).unionByName(refused).unionByName(checked))
    counted = issues.gate(everything)
    verdict = pages.select("batch_id").distinct().join(counted, "batch_id", "left")
    failed = ~F.coalesce("passed", F.lit(True))
    verdict = verdict.select("batch_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), issues.exit_code(F.coalesce("n_issues", F.lit(0)), failed).alias("exit_code"))
    return Outcome(linkage.print_order(grouped), placements, issues.final_order(everything), verdict)
