"""Content dedup, member checks, the batch budget and the batch fingerprint."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..settings import Settings
from ..shipping import ship


def first_by_digest(files: DataFrame, digest: Column, order: Column, *keys: str) -> DataFrame:
    """One row for each digest (within ``keys``), the first in ``order``; all columns stay.

    ``min_by`` combines map-side, so copies of one content never meet unreduced in
    one task, which a window over the digest would make them do.
    """
    grouped = files.select(*keys, digest.alias("__digest"), F.struct(order.alias("__o"), F.struct("*").alias("__row")).alias("__x"))
    first = grouped.groupBy(*keys, "__digest").agg(F.min_by("__x.__row", "__x.__o").alias("__row"))
    return first.select("__row.*")


def unsafe_members(members: DataFrame) -> DataFrame:
    """``members`` (archive_id, member) with whether a name is safe, its key, and whether the key is taken twice."""
    keyed = members.withColumns({"safe": F.coalesce(paths.is_safe_member(F.col("member")), F.lit(False)), "member_key": paths.member_key(F.col("member"))})
    counted = keyed.groupBy("archive_id", "member_key").agg(F.count("*").alias("__n"))
    return keyed.join(counted, ["archive_id", "member_key"]).withColumn("collides", F.col("__n") > 1).drop("__n")


def within_budget(members: DataFrame, settings: Settings | None = None, max_entries: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Members with ``accepted``, folded in order over one budget a batch.

    Every member takes an entry, then its bytes. The first one that finds too
    little left fails its archive: nothing of that archive is accepted, what it took
    so far stays taken, its later members take nothing. Needs batch_id, seq (the
    order), archive_id, bytes. Where there are columns ``used_entries`` and
    ``used_bytes``, a batch begins with so much of its budget taken; where there is a
    column ``unsafe``, such a member takes its entry and fails its archive. Returned are
    also ``entries`` and ``took``, what each member took. The fold is sequential, so a
    batch's list of members, 32 bytes or so each and no contents, meets in one task.
    """
    s = settings or Settings()
    entries, size = max_entries or s.max_files, max_bytes or s.max_bytes

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", kind="stable")
        left, room, failed = entries - int(group["used_entries"].iloc[0]), size - int(group["used_bytes"].iloc[0]), set()
        taken = []
        for archive, n, unsafe in zip(group["archive_id"], group["bytes"], group["unsafe"], strict=True):
            enters = archive not in failed and left > 0
            fits = enters and not unsafe and 0 <= n <= room
            left, room = left - enters, room - (n if fits else 0)
            if not fits:
                failed.add(archive)
            taken.append((int(enters), n if fits else 0))
        spent = pd.DataFrame(taken, columns=["entries", "took"], index=group.index)
        return group[names].assign(accepted=~group["archive_id"].isin(failed), entries=spent["entries"], took=spent["took"])

    ship(members.sparkSession)
    names = ["batch_id", "seq", "archive_id", "bytes"]
    known = {"used_entries": F.lit(0), "used_bytes": F.lit(0), "unsafe": F.lit(False)}
    slim = members.select(*names, *[F.col(c) if c in members.columns else v.alias(c) for c, v in known.items()])
    schema = members.select(*names, F.lit(True).alias("accepted"), F.lit(0).cast("long").alias("entries"), F.lit(0).cast("long").alias("took")).schema
    return slim.groupBy("batch_id").applyInPandas(fold, schema)


def fingerprint(sources: DataFrame, settings: Settings, provider: str, manifest_sha256: str | None = None, version: int = 1) -> DataFrame:
    """(batch_id, n_sources, fingerprint): a hash that binds a batch to its contents, settings and provider.

    Hashes the compact JSON of settings, provider and the sorted digests of the
    sources, keys in alphabetical order.
    """
    head = f'{{"host_manifest_sha256":{_quoted(manifest_sha256)},"provider":"{provider}","schema_version":{version},'
    options = f'"settings":{{"item_gap_mm":{settings.item_gap_mm},"page_margin_mm":{settings.page_margin_mm},"render_dpi":{settings.render_dpi}}}'
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("sha256")), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    payload = F.concat(F.lit(head + options + ',"sources":['), listed, F.lit("]}"))
    return sources.groupBy("batch_id").agg(F.count("sha256").alias("n_sources"), F.sha2(payload, 256).alias("fingerprint"))


def _quoted(value: str | None) -> str:
    return "null" if value is None else f'"{value}"'
