"""Reports: recursive redaction, canonical records of issues."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain, count
from pathlib import PurePosixPath

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import issue_id
from ..functions.paths import ABSOLUTE, basename
from ..functions.text import REDACTIONS, SECRET_MARK, SECRET_NAME, redacted
from ..shipping import ship

_MARKS = [(regex.compile(pattern), mark) for pattern, mark in REDACTIONS]
_SECRET = regex.compile(SECRET_NAME)
_ABSOLUTE = regex.compile(ABSOLUTE)
_NO_NAME, _SECRET_NAME = "[EMPTY KEY]", "[REDACTED KEY]"


def _shown(text: str, is_path: bool = False) -> str:
    """A text with numbers marked; of a path the last part only."""
    for pattern, mark in _MARKS:
        text = pattern.sub(mark, text)
    return PurePosixPath(text.replace("\\", "/")).name if is_path or _ABSOLUTE.match(text) else text


def _names(fields: Iterable[str]) -> dict[str, str]:
    """What each field of an object is called; those that come to be equal are numbered from 2 on, in order of name."""
    found: dict[str, str] = {}
    taken: set[str] = set()
    for field in sorted(fields):
        name = _SECRET_NAME if _SECRET.search(field) else _shown(field) or _NO_NAME
        choices = chain([name], (f"{name}#{n}" for n in count(2)))
        found[field] = next(c for c in choices if c not in taken)
        taken.add(found[field])
    return found


def clean(value, field: str = ""):
    """A JSON value with secrets, numbers and paths redacted, at any depth.

    A worklist of places to fill: an object's names are settled before its values are
    looked at, and a list's values count as values of the field that holds it.
    """
    result: dict = {}
    todo = [(result, "", field, value)]
    while todo:
        into, place, under, found = todo.pop()
        if _SECRET.search(under):
            into[place] = SECRET_MARK
        elif isinstance(found, dict):
            into[place] = names = dict.fromkeys(_names(found).values())
            todo += [(names, shown, name, found[name]) for name, shown in _names(found).items()]
        elif isinstance(found, list):
            into[place] = items = [None] * len(found)
            todo += [(items, i, under, x) for i, x in enumerate(found)]
        elif isinstance(found, str):
            letters = regex.sub("[^a-z0-9]+", "", under.casefold())
            into[place] = _shown(found, letters.endswith("path"))
        else:
            into[place] = found
    return result[""]


def sanitised_json(text: Column) -> Column:
    """Canonical JSON of a redacted document; null where the text isn't JSON. Any depth, so an Arrow function."""

    ship()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else json.dumps(clean(json.loads(x)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        for batch in batches:
            yield batch.map(one)

    return run(text)


def records(issues: DataFrame, sources: DataFrame) -> DataFrame:
    """Issue rows as a report has them: id, redacted texts, and the names of their sources in order, each once.

    ``sources``: batch_id, page_id, path. Source names are looked up by an equality
    join of the exploded ids and put back in their order.
    """
    fields = F.struct("action", "code", "message", "output_page", "severity", "source_page_ids")
    told = issues.withColumn("id", issue_id(fields))
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]))
    names = issues.select("batch_id", "source_page_ids").distinct()
    found = names.select("batch_id", "source_page_ids", F.posexplode("source_page_ids").alias("i", "page_id"))
    found = found.join(sources.select("batch_id", "page_id", basename(F.col("path")).alias("name")), ["batch_id", "page_id"])
    found = found.groupBy("batch_id", "source_page_ids").agg(listed.alias("sources"))
    check = F.when(F.col("output_page").isNull(), "confirm that nothing is missing").otherwise("compare with the original")
    return told.join(found, ["batch_id", "source_page_ids"], "left").select(
        "batch_id",
        "id",
        "code",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
        "source_page_ids",
        "output_page",
        redacted(F.col("message")).alias("problem"),
        redacted(F.col("action")).alias("action"),
        check.alias("suggested_check"),
        "severity",
    )


def that_fit(rows: DataFrame, height: str, room: float, *order: str, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """The prefix of a batch's rows whose heights fit a page: the first one that doesn't ends it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__h", F.sum(height).over(w)).where(F.col("__h") <= room).drop("__h")


def review_page(rows: DataFrame, height: str, room: float, *order: str, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """(keys, n_shown, n_omitted): how many of a batch's rows a page holds, and how many it has to refer to the report."""
    shown = that_fit(rows, height, room, *order, keys=keys).groupBy(*keys).agg(F.count("*").alias("n_shown"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n")).join(shown, list(keys), "left").fillna(0, ["n_shown"])
    return counted.select(*keys, "n_shown", (F.col("__n") - F.col("n_shown")).alias("n_omitted"))
