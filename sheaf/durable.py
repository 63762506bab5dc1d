"""Tables that outlive the executors that made them."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_settled: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    A folder of this machine stands in only where driver and executors are one
    process; on a cluster without a shared folder this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage without copies on single executors: whatever executor is
    lost later, the files remain. They go when ``released``, else when the
    driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    if not _settled:
        atexit.register(_sweep)
    _settled[path] = spark
    df.write.parquet(path)
    nullable = StructType([type(f)(f.name, f.dataType, True) for f in df.schema.fields])
    found = spark.read.schema(nullable).parquet(path)
    found._settled_at = path
    return found


def released(*tables: DataFrame) -> None:
    """Deletes the files of ``settled`` tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = df.__dict__.get("_settled_at")
        if path in _settled:
            _delete(_settled.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for path, spark in list(_settled.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone when the process ends
            return
