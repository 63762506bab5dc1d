"""Archive members as rows. Readers: zip and tar of the standard library, 7z where py7zr is there."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import settled
from ..functions import paths
from ..operators.ingest import unsafe_members, within_budget
from ..settings import Settings
from ..shipping import ship

MEMBER = "batch_id string, archive_id string, place int, member string, bytes long, is_dir boolean, depth int, content binary, error string"


def members(content: bytes, kind: str, most: int) -> Iterator[tuple[str, int, bool, bytes | None]]:
    """(name, declared size, is a folder, content) of each entry; links and devices aren't entries.

    Content is read for ``most`` bytes at the most, so that a false declared size can't
    unpack more; it is null where more is declared.
    """
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                data = None
                if not info.is_dir() and info.file_size <= most:
                    with z.open(info) as f:
                        data = f.read(info.file_size + 1)
                    if len(data) > info.file_size:
                        raise ValueError("a member is larger than declared")
                yield info.filename, 0 if info.is_dir() else info.file_size, info.is_dir(), data
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                if info.isfile():
                    data = t.extractfile(info).read(info.size) if info.size <= most else None
                    yield info.name, info.size, False, data
    elif kind == "7z":
        import py7zr

        with py7zr.SevenZipFile(io.BytesIO(content)) as z:
            sizes = {i.filename: (i.uncompressed, i.is_directory) for i in z.list()}
            factory = py7zr.io.BytesIOFactory(most)
            z.extractall(factory=factory)
            for name, (size, folder) in sizes.items():
                yield name, 0 if folder else size, folder, None if folder else factory.get(name).read()
    else:
        raise ValueError(f"no reader for {kind}")


def list_members(archives: DataFrame, settings: Settings, depth: int = 1) -> DataFrame:
    """Rows of MEMBER for archives (batch_id, archive_id, kind, content); an unreadable one gives a single row with an error."""
    most = settings.max_bytes
    ship(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in MEMBER.split(", ")]
        for batch in batches:
            for a in batch.itertuples():
                rows, error = [], None
                try:
                    for place, (name, size, folder, data) in enumerate(members(a.content, a.kind, most)):
                        if place > settings.max_files:
                            break
                        rows.append((a.batch_id, a.archive_id, place, name, size, folder, depth, data, None))
                except Exception as e:  # whatever a damaged archive raises becomes an issue row
                    error = type(e).__name__
                if error:
                    rows = [(a.batch_id, a.archive_id, -1, None, 0, False, depth, None, error)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return archives.select("batch_id", "archive_id", "kind", "content").mapInPandas(run, MEMBER)


def expand(archives: DataFrame, settings: Settings, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted members of one level, issues (batch_id, archive_id, code), and what batches have used (batch_id, used_entries, used_bytes).

    An archive with an unsafe or doubled name, over the budget or unreadable is left
    out whole; what it took until it failed stays taken. Folders take an entry and
    give no row. Every archive is unpacked once: its members are settled.
    """
    listed = settled(list_members(archives, settings))
    failed = listed.where("error IS NOT NULL").select("batch_id", "archive_id", F.lit("archive_failed").alias("code"))
    good = listed.where("error IS NULL")
    checked = unsafe_members(good.where("NOT is_dir").select("batch_id", "archive_id", "member"))
    odd = checked.where(~F.col("safe") | F.col("collides")).select("batch_id", "archive_id", "member").distinct()
    unsafe = odd.select("batch_id", "archive_id").distinct().withColumn("code", F.lit("unsafe_archive_member"))
    ordered = good.withColumn("seq", F.format_string("%s\x1f%010d", "archive_id", "place"))
    ordered = ordered.join(odd.withColumn("unsafe", F.lit(True)), ["batch_id", "archive_id", "member"], "left").fillna({"unsafe": False})
    if used is not None:
        ordered = ordered.join(used, "batch_id", "left").fillna({"used_entries": 0, "used_bytes": 0})
    budget = settled(within_budget(ordered, settings))
    spent = budget.groupBy("batch_id").agg(F.sum("entries").alias("used_entries"), F.sum("took").alias("used_bytes"))
    if used is not None:
        spent = used.unionByName(spent).groupBy("batch_id").agg(F.sum("used_entries").alias("used_entries"), F.sum("used_bytes").alias("used_bytes"))
    over = budget.where("NOT accepted").select("batch_id", "archive_id").distinct()
    over = over.join(unsafe, ["batch_id", "archive_id"], "left_anti").withColumn("code", F.lit("archive_limit"))
    issues = failed.unionByName(unsafe).unionByName(over)
    kept = good.join(issues.select("batch_id", "archive_id").distinct(), ["batch_id", "archive_id"], "left_anti").where("NOT is_dir")
    return kept.select("batch_id", "archive_id", "place", "member", "bytes", "depth", "content", F.sha2("content", 256).alias("sha256")), issues, settled(spent)


def expand_all(archives: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Files of archives in archives, ``max_depth`` levels deep; deeper ones are issues. One budget a batch over all levels."""
    used: DataFrame | None = None
    level, files, issues = archives.select("batch_id", "archive_id", "kind", "content"), None, None
    for depth in range(1, settings.max_depth + 1):
        found, trouble, used = expand(level, settings, used)
        kind = paths.archive_kind(F.col("member"))
        plain = found.where(kind.isNull() & paths.is_supported(F.col("member"))).withColumn("depth", F.lit(depth))
        odd = found.where(kind.isNull() & ~paths.is_supported(F.col("member"))).select("batch_id", "archive_id", F.lit("unsupported_format").alias("code"))
        files = plain if files is None else files.unionByName(plain)
        issues = trouble.unionByName(odd) if issues is None else issues.unionByName(trouble).unionByName(odd)
        level = found.where(kind.isNotNull()).select("batch_id", F.concat_ws("!", "archive_id", "member").alias("archive_id"), kind.alias("kind"), "content")
    too_deep = level.select("batch_id", "archive_id", F.lit("archive_depth_exceeded").alias("code"))
    return files, issues.unionByName(too_deep)
