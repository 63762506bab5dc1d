"""Identifiers made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def group_id(members: Column) -> Column:
    """``group-`` and 16 hex digits of the sorted member ids joined by a unit separator."""
    return F.concat(F.lit("group-"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\x1f"), 256), 1, 16))


def canonical_json(value: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept; numbers come out in their shortest form."""
    return F.parse_json(F.to_json(value, {"ignoreNullFields": "false"})).cast("string")


def issue_id(issue: Column) -> Column:
    return F.concat(F.lit("W-"), F.upper(F.substring(F.sha2(canonical_json(issue), 256), 1, 10)))


def coded(code: Column) -> Column:
    """A warning code as it is where well-formed, else a hash of it."""
    return F.when(code.rlike(r"^[a-z0-9_]+\z"), code).otherwise(F.concat(F.lit("H-"), F.substring(F.sha2(code, 256), 1, 16)))
