"""Structured companions: leaf fields of XML files, and manifests of observations."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_name
from ..shipping import ship

MAX_XML_BYTES = 20 * 1024 * 1024
MANIFEST_KEYS = ["observation", "page_id", "preview_sha256"]


def leaves(content: bytes) -> list[dict[str, str]]:
    """Local names and trimmed texts of childless elements; the first of a name counts."""
    found: dict[str, str] = {}
    for element in ET.fromstring(content).iter():
        text = (element.text or "").strip()
        if not len(element) and text:
            found.setdefault(element.tag.rpartition("}")[2], text)
    return [{"key": k, "value": v} for k, v in found.items()]


def xml_metadata(files: DataFrame) -> DataFrame:
    """(batch_id, id, metadata, code) of XML files (batch_id, id, content).

    Files over the size cap, with a document type or entities, or not well-formed
    have no metadata and the code ``xml_metadata_invalid``. Declarations are looked
    for in the bytes as well as in UTF-16, before any parser sees them.
    """
    text = F.upper(F.regexp_replace(F.decode(F.col("content"), "ISO-8859-1"), "\\x00", ""))
    refused = (F.octet_length("content") > MAX_XML_BYTES) | text.contains("<!DOCTYPE") | text.contains("<!ENTITY")
    ship(files.sparkSession)
    entry = "array<struct<key:string,value:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, codes = [], []
            for content in batch["content"]:
                try:
                    found.append(leaves(content))
                    codes.append(None)
                except (ET.ParseError, LookupError, ValueError):
                    found.append(None)
                    codes.append("xml_metadata_invalid")
            yield batch[["batch_id", "id"]].assign(metadata=found, code=codes)

    schema = f"batch_id string, id string, metadata {entry}, code string"
    parsed = files.where(~refused).select("batch_id", "id", "content").mapInPandas(run, schema)
    bad = files.where(refused).select("batch_id", "id", F.lit(None).cast(entry).alias("metadata"), F.lit("xml_metadata_invalid").alias("code"))
    return parsed.unionByName(bad)


def leaf_entries(json_text: Column) -> Column:
    """(key, value) of the scalar fields of a JSON object, in order of name."""
    fields = F.from_json(json_text, "map<string,string>")
    return F.filter(F.array_sort(F.map_entries(fields)), lambda e: F.coalesce(F.trim(e["value"]), F.lit("")) != "")


def manifest(spark: SparkSession, text: DataFrame) -> DataFrame:
    """(page_id, digest, observation, valid) of the entries of manifests (json).

    A manifest has the one key ``pages``, an entry exactly the three keys of
    MANIFEST_KEYS; what has others isn't valid.
    """
    entries = F.from_json(F.get_json_object("json", "$.pages"), "array<string>")
    only = F.coalesce(F.json_object_keys("json") == F.array(F.lit("pages")), F.lit(False))
    one = text.select(only.alias("whole"), F.explode(entries).alias("e"))
    keys = F.array_sort(F.json_object_keys("e"))
    return one.select(
        F.get_json_object("e", "$.page_id").alias("page_id"),
        F.get_json_object("e", "$.preview_sha256").alias("digest"),
        F.get_json_object("e", "$.observation").alias("observation"),
        (F.col("whole") & F.coalesce(keys == F.array(*map(F.lit, MANIFEST_KEYS)), F.lit(False))).alias("valid"),
    )


def observation_request(pages: DataFrame) -> DataFrame:
    """One JSON request a page: its id, preview and the digest that an answer has to name."""
    body = F.struct("page_id", F.col("preview").alias("preview_path"), F.col("preview_sha256"))
    return pages.select("batch_id", "page_id", F.to_json(body).alias("request"))


__all__ = ["leaf_entries", "leaves", "local_name", "manifest", "observation_request", "xml_metadata"]
