"""Joins that bind observations and metadata to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metadata keys that are taken, and the fields they become.
METADATA_FIELDS = {
    "invoiceno": "invoice_number",
    "invoicenumber": "invoice_number",
    "orderno": "order_number",
    "ordernumber": "order_number",
    "passenger": "traveler",
    "traveler": "traveler",
    "vendor": "vendor",
    "seller": "vendor",
    "sellername": "vendor",
}


def only_one(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key nobody else has; counted map-side, so that no frequent key is gathered."""
    single = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return rows.join(single, list(keys), "left_semi")


def companions(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Pairs of rows that are each the only one of their side with the key."""
    return only_one(left, *keys).join(only_one(right, *keys), list(keys))


def bind(pages: DataFrame, manifest: DataFrame, *keys: str) -> DataFrame:
    """The keys and a status for every page and manifest entry.

    ``pages`` and ``manifest`` carry a ``digest``. Status: duplicate (a key stands
    twice on a side), missing (no entry), extra (no page), stale (digests differ or
    one is null), matched. A manifest is accepted if all are matched.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.min("digest").alias(f"d_{name}"))

    both = side(pages, "page").join(side(manifest, "entry"), list(keys), "full_outer")
    status = (
        F.when((F.col("n_page") > 1) | (F.col("n_entry") > 1), "duplicate")
        .when(F.col("n_entry").isNull(), "missing")
        .when(F.col("n_page").isNull(), "extra")
        .when(F.coalesce(F.col("d_page") == F.col("d_entry"), F.lit(False)), "matched")
        .otherwise("stale")
    )
    return both.select(*keys, status.alias("status"))


def accepted(bound: DataFrame) -> DataFrame:
    return bound.agg(F.bool_and(F.col("status") == "matched").alias("accepted"))


def metadata_fields(entries: Column) -> Column:
    """A map of taken fields from an array of (key, value) structs; the first of a field wins."""
    table = F.create_map(*[F.lit(x) for pair in METADATA_FIELDS.items() for x in pair])
    taken = F.filter(
        F.transform(entries, lambda e: F.struct(F.try_element_at(table, F.lower(e["key"])).alias("key"), e["value"].alias("value"))),
        lambda e: e["key"].isNotNull() & (F.coalesce(e["value"], F.lit("")) != ""),
    )
    names = F.array_distinct(F.transform(taken, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(taken, lambda e: e["key"] == n), 1)["value"]))


def metadata_amount(entries: Column) -> Column:
    """The first ``amount`` that is a number."""
    values = F.filter(
        F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == "amount"), lambda e: F.trim(e["value"]).try_cast("decimal(18,2)")),
        lambda v: v.isNotNull(),
    )
    return F.get(values, F.lit(0))
