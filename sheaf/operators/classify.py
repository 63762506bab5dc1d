"""Categories in the order in which they are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories by rank.
CATEGORIES = [
    "flight_itinerary",
    "rail_ticket",
    "lodging_invoice",
    "lodging_statement",
    "taxi_invoice",
    "taxi_itinerary",
    "other_transport",
    "physical_ticket_photo",
    "unknown",
]


def rank_in(value: Column, ordered: list[str]) -> Column:
    """The place of a value in a fixed order, null for one that isn't there."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(ordered) for x in (v, i)])
    return F.try_element_at(table, value)


def category_rank(document_type: Column) -> Column:
    return rank_in(document_type, CATEGORIES)
