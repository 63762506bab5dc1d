"""A landing zone: new files are taken in micro-batches, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, max_files: int = 1_000) -> DataFrame:
    """A stream of files as they arrive, with their digests."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(folder)
    return stream.withColumn("sha256", F.sha2("content", 256))


def first_arrivals(files: DataFrame, late: str = "7 days") -> DataFrame:
    """The first file of each content within the watermark; older digests are forgotten."""
    return files.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"])


def land(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Takes all that is there into ``target``, a folder for each micro-batch.

    A micro-batch that is run again after a failure overwrites its own folder, so
    that nothing arrives twice.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
