"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  ``run`` writes each
stage's rows as Parquet to the shared folder and rereads them, so a lost executor costs one stage at most.
Tables that a stage writes for itself are deleted when its rows are written.
All but the last return the columns of ``documents``; the mix adds its figures and leaves out what it does
not take.  Near-dedup and decontamination of texts that stages before them have rewritten have no SQL that
ends in time on whole tables, so ORACLE_SQL is None and tests/llm/test_pipeline.py compares the rows of each stage,
and of ``run``, with a plain Python version on a small planted table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebase.llm import decontam, line_dedup, mixing, near_dedup, quality_rules
from lorebase.llm.common import materialize, scratch, table


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    return quality_rules.clean(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs deleted; documents that held nothing else go."""
    return line_dedup.clean(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", by_quality),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            docs = materialize(rows, "stage-" + name.replace(" ", "-"), keep=True)
    return docs
