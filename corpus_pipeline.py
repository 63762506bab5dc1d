"""The corpus pipeline: every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import common, stages

STAGES = [
    ("quality rules", stages.quality_rule_stage),
    ("line dedup", stages.line_dedup_stage),
    ("simhash near-dedup", stages.near_dedup_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("bpe encoding and decoding", stages.bpe_stage),
]

#: Fitted cutoffs, fingerprints and BPE merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` applied to ``documents``; what each stage keeps is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, before = common.settled(stage(spark, docs, sf_dir)), docs
        common.released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
