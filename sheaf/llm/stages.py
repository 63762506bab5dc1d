"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame with the columns of ``documents``.

Each takes any table with these columns, others are left out, and an empty table
gives an empty one. Nulls in any column are allowed: a null text is an empty one,
a null doc_id is a document whose id sorts last. Equal rows are separate documents
but for near-dedup, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as bpe_op
from . import decontaminate, line_dedup, quality_rules, set_links
from .common import DOCUMENT_COLUMNS, documents_again, table


def quality_rules_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the rules keep."""
    judged = quality_rules.judge(docs, labels, F.struct("*").alias("doc"))
    return judged.where("kept").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules_kept(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, were they to become empty."""
    return documents_again(line_dedup.dedup_lines(docs.select(*DOCUMENT_COLUMNS)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, five-word shingles and 0.8, stays, that of the smallest doc_id."""
    return set_links.keep_one(docs.select(*DOCUMENT_COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe_op.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
