"""The release gate: metrics of a run's outcome against an expected one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordinals(rows: DataFrame, key: str, *order: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.select(*keys, F.row_number().over(w).alias("ordinal"), F.col(key).alias("key"))


def order_accuracy(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Share of places, out of the longer order, at which both have the same key."""
    both = expected.withColumnRenamed("key", "e").join(actual.withColumnRenamed("key", "a"), [*keys, "ordinal"], "full_outer")
    same = F.coalesce(F.col("e") == F.col("a"), F.lit(False)).cast("double")
    return both.groupBy(*keys).agg(F.avg(same).alias("order_accuracy"))


def coverage(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Expected keys that are missing, unexpected ones, and surplus repeats."""
    a = actual.groupBy(*keys, "key").agg(F.count("*").alias("n"))
    e = expected.select(*keys, "key").distinct().withColumn("wanted", F.lit(True))
    both = e.join(a, [*keys, "key"], "full_outer")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("n").isNull()).alias("n_omitted"),
        F.count_if(F.col("wanted").isNull()).alias("n_unexpected"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def recall(expected: DataFrame, actual: DataFrame, value: str, name: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Share of distinct expected values that occur; 1 where none is expected."""
    cases = expected.select(*keys).unionByName(actual.select(*keys)).distinct()
    wanted = expected.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    found = wanted.join(actual.select(*keys, value).distinct().withColumn("__f", F.lit(1.0)), [*keys, value], "left")
    shares = found.groupBy(*keys).agg(F.avg(F.coalesce("__f", F.lit(0.0))).alias(name))
    return cases.join(shares, list(keys), "left").select(*keys, F.coalesce(name, F.lit(1.0)).alias(name))


def same_sets(expected: DataFrame, actual: DataFrame, value: str, name: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """1 where both have the same distinct values, else 0."""
    e = expected.select(*keys, value).distinct().withColumn("__e", F.lit(1))
    a = actual.select(*keys, value).distinct().withColumn("__a", F.lit(1))
    both = e.join(a, [*keys, value], "full_outer")
    return both.groupBy(*keys).agg(F.min(F.when(F.col("__e").isNotNull() & F.col("__a").isNotNull(), 1.0).otherwise(0.0)).alias(name))


def gate(metrics: DataFrame) -> DataFrame:
    """``release_gate_passed``: all rates 1, all counts 0."""
    rates = [c for c in ("order_accuracy", "association_accuracy", "warning_recall", "a4_rate") if c in metrics.columns]
    counts = [c for c in ("n_omitted", "n_unexpected", "n_duplicates", "n_crop_findings", "n_annotations", "n_review_pages") if c in metrics.columns]
    passed = F.lit(True)
    for c in rates:
        passed = passed & (F.coalesce(F.col(c), F.lit(0.0)) == 1.0)
    for c in counts:
        passed = passed & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return metrics.withColumn("release_gate_passed", passed)


def page_keys(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """``sha256:index`` of every page."""
    joined = pages.join(sources.select(F.col("id").alias("source_id"), "sha256"), "source_id")
    return joined.select("page_id", F.concat_ws(":", "sha256", F.col("page_index").cast("string")).alias("key"))


def page_metrics(pages: DataFrame, placed: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Share of A4 pages (1 point of tolerance), pages beyond those placed on, and annotations."""
    fits = (F.abs(F.col("width_pt") - 210 * 72 / 25.4) <= 1) & (F.abs(F.col("height_pt") - 297 * 72 / 25.4) <= 1)
    p = pages.groupBy(*keys).agg(F.avg(fits.cast("double")).alias("a4_rate"), F.count("*").alias("__n"), F.sum("n_annotations").alias("n_annotations"))
    used = placed.groupBy(*keys).agg(F.count_distinct("output_page").alias("__used"))
    surplus = F.greatest(F.col("__n") - F.coalesce("__used", F.lit(0)), F.lit(0))
    return p.join(used, list(keys), "left").select(*keys, "a4_rate", "n_annotations", surplus.alias("n_review_pages"))


def valid_expectation(cases: DataFrame) -> DataFrame:
    """Whether a case's page keys are well-formed and unique, its groups not empty, its codes well-formed."""
    keys_fine = F.forall("page_order", lambda k: k.rlike(r"^[0-9a-f]{64}:[0-9]+\z"))
    unique = F.size(F.array_distinct("page_order")) == F.size("page_order")
    groups_fine = F.forall("association_groups", lambda g: (F.size(g) > 0) & (F.size(F.array_distinct(g)) == F.size(g)))
    codes_fine = F.forall("warning_codes", lambda c: c.rlike(r"^[a-z0-9_]+\z"))
    return cases.withColumn("valid", F.coalesce(keys_fine & unique & groups_fine & codes_fine, F.lit(False)))


def placed_keys(placements: DataFrame, keyed: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(keys, ordinal, key, output_page, valid): placements by page key, in order of output page, y, x and key.

    ``placements``: page_id, output_page, x, y; ``keyed``: page_id, key. Invalid are an
    unknown page, a null or negative output page, and coordinates that are no numbers.
    """
    found = placements.join(keyed.select(*keys, "page_id", "key"), [*keys, "page_id"], "left")
    valid = F.col("key").isNotNull() & (F.col("output_page") >= 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("output_page", "y", "x", "key"))
    return found.select(*keys, place.alias("ordinal"), "key", "output_page", F.coalesce(valid, F.lit(False)).alias("valid"))


def group_keys(groups: DataFrame, keyed: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(keys, members): each distinct set of page keys that the groups (group_id, page_ids) give; null where a page is unknown or repeated."""
    places = groups.select(*keys, "group_id", F.explode_outer("page_ids").alias("page_id"))
    found = places.join(keyed.select(*keys, "page_id", "key"), [*keys, "page_id"], "left").groupBy(*keys, "group_id").agg(
        F.array_sort(F.collect_list("key")).alias("members"), F.count("*").alias("__n")
    )
    whole = (F.size("members") == F.col("__n")) & (F.size(F.array_distinct("members")) == F.col("__n"))
    return found.select(*keys, F.when(whole, F.col("members")).alias("members")).distinct()
