"""Issues as rows: hard and soft codes, the gate, canonical orders, the exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "batch_id string, code string, severity string, source_page_ids array<string>, output_page int, message string, action string"
#: Codes that fail a batch.
HARD = [
    "asset_duplicate",
    "asset_mapping_mismatch",
    "content_mismatch",
    "content_verification_failed",
    "pdf_annotations",
    "pdf_empty",
    "pdf_encrypted",
    "pdf_non_a4",
    "pdf_page_clipped",
    "pdf_page_count",
    "pdf_unreadable",
    "placement_aspect_mismatch",
    "placement_clipped",
    "placement_duplicate",
    "placement_invalid",
    "placement_missing",
    "placement_overlap",
    "placement_page_gap",
    "placement_unknown_asset",
    "render_size_mismatch",
    "renderer_failed",
    "renderer_missing",
    "source_asset_invalid",
    "source_resolution_unverifiable",
    "unexpected_output_content",
]

#: What is told of a code, and what to do about it.
TEXTS = {
    "asset_duplicate": ("A normalized source page appears more than once.", "Keep exactly one immutable asset for each source page."),
    "asset_mapping_mismatch": ("A normalized source page does not match its asset mapping.", "Rebuild the normalized asset mapping and compose again."),
    "content_mismatch": ("The rendered placement does not match its immutable source crop.", "Compose this page again from the matching normalized source."),
    "content_verification_failed": ("The placement content could not be verified safely.", "Repair the local renderer and verify this placement again."),
    "crop_low_observation_confidence": ("Automatic cropping was skipped because page analysis confidence is low.", "Review the page classification before printing."),
    "crop_physical_ticket_photo": ("Automatic cropping was skipped for a physical ticket photo.", "Keep the full photo and review its print size."),
    "crop_preview_invalid": ("Automatic cropping was skipped because the page preview could not be read.", "Regenerate the page preview and retry."),
    "crop_protected_region_unsafe": ("Automatic cropping was skipped because a protected region is too close to a page edge.", "Review the protected text and code regions before printing."),
    "crop_uncertain": ("Automatic cropping was skipped because the outer margins are not confidently uniform.", "Review the full page and crop it manually only if the outer area is disposable."),
    "low_observation_confidence": ("An electronic page has a low-confidence observation.", "Review the retained full-page ticket content."),
    "low_source_resolution": ("A source page may print below the requested raster resolution.", "Use a higher-resolution original if available; do not enhance this file."),
    "pdf_annotations": ("An output page contains interactive PDF annotations.", "Compose again after removing annotations from source pages."),
    "pdf_empty": ("The composed PDF contains no printable pages.", "Compose at least one verified A4 page."),
    "pdf_encrypted": ("The composed PDF is encrypted and cannot be verified.", "Compose an unencrypted printable PDF."),
    "pdf_non_a4": ("An output page is not unrotated portrait A4.", "Compose this page on an unrotated portrait A4 canvas."),
    "pdf_page_clipped": ("An output page crop box clips the A4 canvas.", "Compose again with a full-page A4 crop box."),
    "pdf_page_count": ("The composed PDF page count does not match the placements.", "Compose again from the verified placement list."),
    "pdf_unreadable": ("The composed PDF is missing, corrupt, or unreadable.", "Compose the printable PDF again from immutable inputs."),
    "physical_ticket_attach_original": ("A physical ticket photo was excluded from electronic ticket pages.", "Attach the original physical ticket separately."),
    "placement_aspect_mismatch": ("A placement changes the normalized crop aspect ratio.", "Preserve the source crop aspect ratio and compose again."),
    "placement_clipped": ("A placement extends beyond the printable A4 page.", "Re-layout this source page fully inside the A4 bounds."),
    "placement_duplicate": ("A source page is placed more than once.", "Remove the duplicate placement and compose again."),
    "placement_invalid": ("A placement has invalid page or geometry coordinates.", "Recompute this placement from immutable source geometry."),
    "placement_missing": ("A normalized source page is missing from the output placements.", "Add the omitted source page and compose again."),
    "placement_overlap": ("Two source pages overlap on the composed A4 page.", "Re-layout the source pages without overlap."),
    "placement_page_gap": ("Output page indices are not contiguous from the first page.", "Rebuild output pages with contiguous page indices."),
    "placement_unknown_asset": ("A placement has no matching normalized source page.", "Rebuild placements from the normalized asset inventory."),
    "render_size_mismatch": ("The rendered page pixel dimensions do not match A4 at the requested DPI.", "Check the A4 canvas and renderer DPI, then verify again."),
    "renderer_failed": ("The deterministic renderer could not render this output page.", "Repair the local renderer and run verification again."),
    "renderer_missing": ("The bundled deterministic PDF renderer is unavailable.", "Reinstall the complete runtime bundle and verify again."),
    "source_asset_invalid": ("A normalized source page cannot be verified against its metadata.", "Normalize this source page again before composing."),
    "source_resolution_unverifiable": ("The source raster resolution cannot be verified safely.", "Normalize this source again or provide a verifiable original."),
    "unexpected_output_content": ("Rendered content exists outside all verified placements.", "Remove the extra content and compose this A4 page again."),
    "unknown_document": ("An electronic page could not be classified.", "Review the retained full-page ticket content."),
}
#: The same of a whole output page, and of linkage.
PAGE_TEXTS = {"content_verification_failed": ("The complete output page could not be verified safely.", "Repair the local renderer and verify this page again.")}
_REVIEW_SUPPORT = "Review the support document and its intended primary document."
LINK_TEXTS = {
    "ambiguous_association": ("A support document has multiple plausible associations.", _REVIEW_SUPPORT),
    "association_competition": ("A support document could not be assigned one-to-one.", _REVIEW_SUPPORT),
    "low_confidence_association": ("A possible document association lacks sufficient evidence.", _REVIEW_SUPPORT),
    "low_observation_confidence": ("A possible association relies on a low-confidence observation.", _REVIEW_SUPPORT),
    "unmatched_support": ("No compatible primary document was found for a support document.", _REVIEW_SUPPORT),
}


def issue(batch_id: Column, code: Column | str, ids: Column, page: Column | None = None, texts: dict[str, tuple[str, str]] = TEXTS) -> list[Column]:
    """The columns of SCHEMA: hard codes are errors, others warnings; a code that ``texts`` lacks has empty ones."""
    code = F.lit(code) if isinstance(code, str) else code

    def told(part: int) -> Column:
        known = F.create_map(*[F.lit(x) for name, pair in texts.items() for x in (name, pair[part])])
        return F.coalesce(F.try_element_at(known, code), F.lit(""))

    return [
        batch_id.cast("string").alias("batch_id"),
        code.alias("code"),
        F.when(is_hard(code), "error").otherwise("warning").alias("severity"),
        ids.cast("array<string>").alias("source_page_ids"),
        (F.lit(None) if page is None else page).cast("int").alias("output_page"),
        told(0).alias("message"),
        told(1).alias("action"),
    ]


def is_hard(code: Column) -> Column:
    return code.isin(HARD)


def verification_order(issues: DataFrame) -> DataFrame:
    """Hard codes first, then by page (none last), ids, code and message."""
    page = F.coalesce(F.col("output_page").cast("long"), F.lit(2**31))
    return issues.orderBy(F.when(is_hard(F.col("code")), 0).otherwise(1), page, "source_page_ids", "code", "message")


def final_order(issues: DataFrame) -> DataFrame:
    return issues.orderBy("severity", "code", "source_page_ids", F.coalesce("output_page", F.lit(-1)), "message", "action")


def gate(issues: DataFrame) -> DataFrame:
    """(batch_id, n_issues, n_hard, passed) of each batch that has issues."""
    return issues.groupBy("batch_id").agg(
        F.count("*").alias("n_issues"),
        F.count_if(is_hard(F.col("code"))).alias("n_hard"),
        (~F.bool_or(is_hard(F.col("code")))).alias("passed"),
    )


def exit_code(n_issues: Column, failed: Column) -> Column:
    return F.when(failed, 1).when(n_issues > 0, 2).otherwise(0)
