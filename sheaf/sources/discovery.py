"""Sources of a batch: files listed, archives expanded, contents taken once, the rest told of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import settled
from ..functions import paths
from ..operators.ingest import first_by_digest
from ..settings import Settings
from . import archives, tables


def discover_sources(spark: SparkSession, folder: str, batch_id: str, settings: Settings, work_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, issues) of all files below a folder but those in ``work_dir``.

    Sources: batch_id, source_id, path, archive_member, depth, sha256, media_type,
    content, each content once: the first by depth, path and place in its archive.
    Issues: batch_id, path, code (unsupported_format, or what ``expand_all`` tells).
    An empty folder gives no rows.
    """
    listed = tables.discover(spark, folder, batch_id)
    if work_dir is not None:
        own = F.regexp_replace(F.lit(work_dir.rstrip("/")), "^file:/*", "/")
        listed = listed.where(~paths.overlaps(F.regexp_replace("path", "^file:/*", "/"), own))
    files = settled(listed)
    plain = files.where("kind = 'file'").select(
        "batch_id", "path", F.lit(None).cast("string").alias("archive_member"), F.lit(0).alias("depth"), F.lit(0).alias("place"), "sha256", "media_type", "content"
    )
    packed = files.where("kind NOT IN ('file', 'unsupported')").select("batch_id", F.col("path").alias("archive_id"), "kind", "content")
    inner, trouble = archives.expand_all(packed, settings)
    member = F.col("member")
    nested = inner.select(
        "batch_id", F.col("archive_id").alias("path"), member.alias("archive_member"), "depth", "place", "sha256", paths.media_type(member).alias("media_type"), "content"
    )
    order = F.struct("depth", F.lower("path").alias("p"), "place")
    taken = first_by_digest(plain.unionByName(nested), F.col("sha256"), order, "batch_id")
    sources = taken.select("batch_id", F.substring("sha256", 1, 16).alias("source_id"), "path", "archive_member", "depth", "sha256", "media_type", "content")
    odd = files.where("kind = 'unsupported'").select("batch_id", "path", F.lit("unsupported_format").alias("code"))
    return sources, odd.unionByName(trouble.select("batch_id", F.col("archive_id").alias("path"), "code"))


def normalisation_issues(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """(batch_id, source_id, code): metadata without a page of its own, and sources that gave an error for pages."""
    xml = sources.where("media_type = 'application/xml'").select("batch_id", "source_id", F.lit("xml_requires_layout_companion").alias("code"))
    failed = pages.where("error IS NOT NULL").select("batch_id", "source_id", F.lit("normalization_failed").alias("code"))
    return xml.unionByName(failed)
