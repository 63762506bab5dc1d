"""Writing results: canonical JSON, and several outputs that appear together or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def canonical(value) -> str:
    """UTF-8 JSON with sorted keys, two spaces of indent and a newline at the end."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, separators=(",", ": ")) + "\n"


def _paths(spark: SparkSession, *names: str):
    jvm = spark._jvm
    found = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), found


def publish(spark: SparkSession, outputs: dict[str, DataFrame], folder: str) -> None:
    """Every output as ``folder/name`` in Parquet, all or none.

    Outputs are staged beside the folder and moved by renames through Hadoop's file
    system; if one fails, those moved go back and what stood there before returns.
    """
    mark = uuid.uuid4().hex
    staged = {n: f"{folder}/.staged-{mark}/{n}" for n in outputs}
    fs, (root,) = _paths(spark, folder)
    done: list[tuple[str, str | None]] = []
    try:
        for name, df in outputs.items():
            df.write.parquet(staged[name])
        for name in outputs:
            _, (source, target, backup) = _paths(spark, staged[name], f"{folder}/{name}", f"{folder}/.before-{mark}/{name}")
            old = None
            if fs.exists(target):
                fs.mkdirs(backup.getParent())
                if not fs.rename(target, backup):
                    raise OSError(f"{name} can't be set aside")
                old = str(backup)
            done.append((name, old))
            if not fs.rename(source, target):
                raise OSError(f"{name} can't be published")
    except BaseException:
        for name, old in reversed(done):
            _, (target,) = _paths(spark, f"{folder}/{name}")
            fs.delete(target, True)
            if old:
                _, (backup, target) = _paths(spark, old, f"{folder}/{name}")
                fs.rename(backup, target)
        raise
    finally:
        for rest in (f"{folder}/.staged-{mark}", f"{folder}/.before-{mark}"):
            _, (path,) = _paths(spark, rest)
            fs.delete(path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole before it gets its name."""
    fs, (part, target) = _paths(spark, f"{path}.{uuid.uuid4().hex}", path)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} can't be written")
