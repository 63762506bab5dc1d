"""Observations of pages by provider, the inputs that a layout needs, and canonical orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compatible
from . import binding

#: The columns that rows of each kind are ordered by within a batch.
ORDERS = {
    "pages": ("page_id",),
    "candidates": ("support_id", "primary_id"),
    "link_issues": ("source_page_ids", "code"),
    "placements": ("output_page", "y", "x", "page_id"),
}
#: Confidence of a local observation with metadata, with text only, with neither.
WITH_METADATA, WITH_TEXT, WITHOUT = 0.7, 0.4, 0.2


def in_order(rows: DataFrame, kind: str, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """``rows`` with their ``ordinal`` (from 1) in a batch, in the canonical order of their kind."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDERS[kind])))


def provider_of(provider: Column, has_manifest: Column) -> Column:
    """``auto`` is host where there is a manifest, else local."""
    return F.when(provider != "auto", provider).otherwise(F.when(has_manifest, "host").otherwise("local"))


def is_renderable(media_type: Column) -> Column:
    """Whether a source can give printable pages; null counts as no."""
    return F.coalesce(media_type.isin("application/pdf", "application/ofd") | media_type.startswith("image/"), F.lit(False))


def provider_errors(batches: DataFrame, sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(batch_id, error) of batches that can't be observed as asked.

    ``batches``: batch_id, provider, has_manifest. host_manifest_missing: host without a
    manifest; image_requires_host: local with an image among the ``sources`` (batch_id,
    media_type); no_pages: nothing to lay out. The first of these that holds is told.
    """
    images = sources.where(F.col("media_type").startswith("image/")).select("batch_id", F.lit(True).alias("__image")).distinct()
    paged = pages.select("batch_id", F.lit(True).alias("__paged")).distinct()
    chosen = provider_of(F.col("provider"), F.col("has_manifest"))
    error = (
        F.when((chosen == "host") & ~F.col("has_manifest"), "host_manifest_missing")
        .when((chosen == "local") & F.col("__image"), "image_requires_host")
        .when(F.col("__paged").isNull(), "no_pages")
    )
    judged = batches.join(images, "batch_id", "left").join(paged, "batch_id", "left")
    return judged.select("batch_id", error.alias("error")).where("error IS NOT NULL")


def host_observations(pages: DataFrame, observations: DataFrame) -> DataFrame:
    """Pages (batch_id, page_id, ...) with ``observation`` and ``error``: observation_missing where the manifest has none.

    ``observations``: batch_id, page_id (each once, as bound), observation.
    """
    found = pages.join(observations.select("batch_id", "page_id", "observation"), ["batch_id", "page_id"], "left")
    return found.withColumn("error", F.when(F.col("observation").isNull(), "observation_missing"))


def local_observations(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(batch_id, page_id, text, confidence, evidence, fields, amount) from text and from a companion's metadata.

    ``pages``: batch_id, page_id, source_id, text (null or blank: none); ``sources``:
    batch_id, source_id, stem, media_type, metadata (array of key and value). Metadata
    goes over where one XML source and one renderable one share a stem in a batch, in
    compatibility form and case folded. ``fields`` is null without metadata.
    """
    keyed = sources.withColumn("__stem", compatible(F.col("stem")))
    xml = keyed.where("media_type = 'application/xml'").select("batch_id", "__stem", "metadata")
    shown = keyed.where(is_renderable(F.col("media_type"))).select("batch_id", "__stem", "source_id")
    given = binding.companions(shown, xml, "batch_id", "__stem").where(F.size("metadata") > 0).select("batch_id", "source_id", "metadata")
    joined = pages.join(given, ["batch_id", "source_id"], "left")
    text = F.coalesce(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), F.lit(""))
    fields, amount = binding.metadata_fields(F.col("metadata")), binding.metadata_amount(F.col("metadata"))
    known = F.coalesce((F.size(fields) > 0) | amount.isNotNull(), F.lit(False))
    evidence = F.array(F.when(text != "", "embedded_pdf_text"), F.when(known, "structured_xml_metadata"))
    return joined.select(
        "batch_id",
        "page_id",
        text.alias("text"),
        F.when(known, WITH_METADATA).when(text != "", WITH_TEXT).otherwise(WITHOUT).alias("confidence"),
        F.array_compact(evidence).alias("evidence"),
        F.when(known, fields).alias("fields"),
        F.when(known, amount).alias("amount"),
    )


def layout_errors(groups: DataFrame, pages: DataFrame, crops: DataFrame, observations: DataFrame) -> DataFrame:
    """(batch_id, page_id, error) of each batch whose layout lacks something: the first place at fault.

    ``groups``: batch_id, group_seq, primary_page_ids, support_page_ids; the others:
    batch_id, page_id. A page is ``repeated`` from its second place on, lacks its
    ``page``, ``crop`` or ``observation``, or is in no group (``ungrouped``, the
    smallest one, told only where all places are fine). Nothing is lost by a join in silence.
    """
    keys = ["batch_id", "page_id"]
    places = groups.select("batch_id", "group_seq", F.posexplode(F.concat("primary_page_ids", "support_page_ids")).alias("item_seq", "page_id"))
    again = F.row_number().over(Window.partitionBy(*keys).orderBy("group_seq", "item_seq")) > 1
    found = places.withColumn("__again", again)
    for name, rows in (("page", pages), ("crop", crops), ("observation", observations)):
        found = found.join(rows.select(*keys, F.lit(True).alias(f"__{name}")).distinct(), keys, "left")
    error = F.when(F.col("__again"), "repeated")
    for name in ("page", "crop", "observation"):
        error = error.when(F.col(f"__{name}").isNull(), name)
    faults = found.select("batch_id", "group_seq", "item_seq", "page_id", error.alias("error")).where("error IS NOT NULL")
    first = faults.groupBy("batch_id").agg(F.min(F.struct("group_seq", "item_seq", "page_id", "error")).alias("f"))
    first = first.select("batch_id", "f.page_id", "f.error")
    left = pages.select(*keys).join(places, keys, "left_anti").groupBy("batch_id").agg(F.min("page_id").alias("page_id"))
    left = left.join(first, "batch_id", "left_anti")
    return first.unionByName(left.select("batch_id", "page_id", F.lit("ungrouped").alias("error")))
