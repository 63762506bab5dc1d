"""Findings in texts and file names that must not be published; matches are never echoed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Patterns, public prefixes and names.
WINDOWS_PATH = r"(?i)(?<![a-z])[a-z]:[\\/][^\r\n]+"
PROFILE_PATH = r"(?i)(?:[a-z]:[\\/](?:users|documents and settings)[\\/][^\\/\r\n]+|/(?:users|home)/[^/\r\n]+)"
POSIX_PATH = r"(?i)(?<![:a-z0-9_.-])/(?:data|finance|home|private|srv|users|var)/[^\s`\"']+"
CREDENTIAL = r"(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})"
MODEL_RESPONSE = r"[\"'](?:model_response|response_body)[\"']\s*:"
TEST_OUTPUT = r"[\"'](?:gray_output_path|gray_report_path)[\"']\s*:"
PUBLIC_WINDOWS = ["\\program files\\", "\\programdata\\", "\\windows\\"]
PUBLIC_POSIX = ["/var/lib/apt/lists"]
ARTIFACTS = [".7z", ".bmp", ".gif", ".gz", ".heic", ".jpeg", ".jpg", ".ofd", ".pdf", ".png", ".rar", ".tar", ".tgz", ".tif", ".tiff", ".webp", ".zip"]
DIRECTORIES = [".model-cache", ".private-fixtures", "gray-output", "model-responses", "output-final", "qa-final"]


def path_reason(path: Column) -> Column:
    """Why a file is not to be published by its name, else null; the first reason counts."""
    name = F.lower(paths.basename(path))
    return (
        F.when(F.arrays_overlap(F.transform(paths.parts(path), F.lower), F.array(*map(F.lit, DIRECTORIES))), "private artifact directory")
        .when(name.rlike(r"^\.env(\..*)?$"), "environment file")
        .when((name == "report.json") | name.rlike("[-_]report\\.json$"), "private report")
        .when(paths.suffix(path).isin(ARTIFACTS), "financial, archive, or preview artifact")
        .when(name.startswith("tmp_gray_"), "one-off gray-test helper")
    )


def _beyond(found: Column, prefixes: list[str], skip: int = 0) -> Column:
    """Whether a match has none of the public prefixes after ``skip`` characters."""

    def public(p: Column) -> Column:
        out = F.lit(False)
        for prefix in prefixes:
            out = out | F.substr(p, F.lit(skip + 1)).startswith(prefix)
        return out

    return F.exists(found, lambda p: ~public(F.lower(p)))


def content_reasons(text: Column) -> Column:
    """All reasons, in a fixed order, not to publish a text."""
    windows = F.transform(F.regexp_extract_all(text, F.lit(WINDOWS_PATH), F.lit(0)), lambda p: F.replace(p, F.lit("/"), F.lit("\\")))
    posix = F.regexp_extract_all(text, F.lit(POSIX_PATH), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(_beyond(windows, PUBLIC_WINDOWS, 2), "absolute Windows path"),
            F.when(text.rlike(PROFILE_PATH), "user-profile absolute path"),
            F.when(_beyond(posix, PUBLIC_POSIX), "private absolute POSIX path"),
            F.when(text.rlike(CREDENTIAL), "credential-like token"),
            F.when(text.rlike(MODEL_RESPONSE), "model-response content"),
            F.when(text.rlike(TEST_OUTPUT), "gray-test output content"),
        )
    )


def scan(files: DataFrame) -> DataFrame:
    """(path, reason) of files (path, text); a reason by name makes its content go unread."""
    by_name = path_reason(F.col("path"))
    reasons = F.when(by_name.isNotNull(), F.array(by_name)).otherwise(content_reasons(F.coalesce("text", F.lit(""))))
    return files.select("path", F.explode(reasons).alias("reason"))


def decoded(content: Column) -> Column:
    """UTF-8 text without a mark, UTF-16 where a mark says so; null for anything else."""
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))
    return F.when(marked, F.decode(content, "UTF-16")).otherwise(utf8)
