"""Tables and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def discover(spark: SparkSession, folder: str, batch_id: str) -> DataFrame:
    """(batch_id, path, seq_key, content, length, sha256, media_type, kind) of all files below a folder.

    Read by ``binaryFile``, wherever Spark can read; ``seq_key`` orders files as they
    are taken. ``kind`` is file, an archive kind, or unsupported.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.col("path")
    kind = F.coalesce(paths.archive_kind(path), F.when(paths.is_supported(path), "file").otherwise("unsupported"))
    return files.select(
        F.lit(batch_id).alias("batch_id"),
        "path",
        F.lower(path).alias("seq_key"),
        "content",
        "length",
        F.sha2("content", 256).alias("sha256"),
        paths.media_type(path).alias("media_type"),
        kind.alias("kind"),
    )
