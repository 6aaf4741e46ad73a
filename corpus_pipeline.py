"""Training-data pipeline over `documents`: each stage is written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All
but the last return the columns of documents, extra ones included; the last adds the mix's figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.common import Scratch, ship, table
from memloom.llm.decontam import decontaminate
from memloom.llm.mixture import mixed_documents
from memloom.llm.pii import redact_documents
from memloom.llm.quality import keep_good
from memloom.llm.simhash import keep_first


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    ship(spark)
    return keep_first(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; benchmark passages in the others are cut out, n_chars follows."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; n_chars follows."""
    ship(spark)
    return redact_documents(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken."""
    ship(spark)
    return mixed_documents(spark, docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("mixing sources to target weights", mixture_stage),
]

#: Compression ratios, fingerprints, decoding and seeded selection have no SQL form; tests use
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        after = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
        scratch.drop(docs)
        docs = after
    return docs
