"""Column expressions over text: folding, redaction, wrapping."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship

#: What is redacted. Digits of any script, as in the patterns' origin.
ID_NUMBER = r"(?<!\p{Nd})\p{Nd}{17}[\p{Nd}Xx](?![\p{Nd}Xx])"
CARD_NUMBER = r"(?<!\p{Nd})(?:\p{Nd}[ -]?){15,18}\p{Nd}(?!\p{Nd})"
SECRET_NAME = r"(?i)(authorization|token|api.?key|password|cookie|client.?secret|credential)"
ID_MARK, CARD_MARK, SECRET_MARK = "[REDACTED PRC ID]", "[REDACTED BANK CARD]", "[REDACTED]"
#: In the order in which they are applied.
REDACTIONS = [(ID_NUMBER, ID_MARK), (CARD_NUMBER, CARD_MARK)]


def _fold(value: str | None) -> str | None:
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).casefold()
    return "".join(c for c in folded if c.isalnum()) or None


def normalised(value: Column) -> Column:
    """Compatibility form, case folded, letters and digits only; null if nothing is left.

    ASCII values stay in the JVM; only others go through an Arrow function, which
    Spark evaluates for all rows of a plan that holds it, so ``normalised_ascii`` is
    there for columns known to be ASCII.
    """

    ship()

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_fold, na_action="ignore")

    return fold(value)


def compatible(value: Column) -> Column:
    """Compatibility form, case folded, nothing left out; no expression of Spark's does either, so an Arrow function."""

    ship()

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")

    return fold(value)


def normalised_ascii(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(value), "[^a-z0-9]", ""), F.lit(""))


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def redacted(value: Column) -> Column:
    """Identity numbers, then card numbers, replaced by a mark."""
    for pattern, mark in REDACTIONS:
        value = F.regexp_replace(value, pattern, mark)
    return value


def sanitised(value: Column, field: Column) -> Column:
    """A field's value for a report: secrets hidden by name, numbers redacted, paths cut to their last part."""
    from .paths import basename, is_absolute, is_path_field

    safe = redacted(value)
    return F.when(field.rlike(SECRET_NAME), SECRET_MARK).when(is_absolute(safe) | is_path_field(field), basename(safe)).otherwise(safe)


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def wrapped(text: Column, widths: Column, limit: float) -> Column:
    """Lines of a text filled greedily, by character; ``widths`` maps characters to widths, others are 1 wide."""

    def step(state: Column, c: Column) -> Column:
        w = F.coalesce(F.try_element_at(widths, c), F.lit(1.0))
        fits = (state["width"] + w <= limit) & (c != "\n")
        return F.struct(
            F.when(fits, state["lines"]).otherwise(F.concat(state["lines"], F.array(state["line"]))).alias("lines"),
            F.when(fits, F.concat(state["line"], c)).when(c == "\n", "").otherwise(c).alias("line"),
            F.when(fits, state["width"] + w).when(c == "\n", 0.0).otherwise(w).alias("width"),
        )

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("width"))
    return F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(s["lines"], F.array(s["line"])))


def truncated(lines: Column, widths: Column, limit: float, most: int) -> Column:
    """At most so many lines; the last one left ends in an ellipsis, and is cut so that both fit."""
    wide = lambda c: F.coalesce(F.try_element_at(widths, c), F.lit(1.0))

    def step(state: Column, c: Column) -> Column:
        width = state["width"] + wide(c)
        return F.struct(F.when(width <= limit, F.concat(state["line"], c)).otherwise(state["line"]).alias("line"), width.alias("width"))

    start = F.struct(F.lit("").alias("line"), wide(F.lit("…")).alias("width"))
    last = F.aggregate(F.split(F.get(lines, F.lit(most - 1)), ""), start, step, lambda s: F.concat(s["line"], F.lit("…")))
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(F.slice(lines, 1, most - 1), F.array(last)))
