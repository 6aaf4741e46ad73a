"""Term frequencies and statistics of a corpus; `plans.stored` keeps its postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.search import corpus_stats, with_terms


def term_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def statistics(memories: DataFrame) -> DataFrame:
    """One row: docs, tokens and mean length. Lengths do not depend on stems."""
    stats = corpus_stats(with_terms(memories, stemmed=False))
    return stats.withColumn("mean_len", F.col("tokens").cast("double") / F.col("docs").cast("double"))
