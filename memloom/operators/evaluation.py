"""Retrieval evaluation: rank metrics, percentiles, bootstrap, coverage and context budgets."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_ranked(hits: DataFrame, excluded: str | None = None) -> DataFrame:
    """First position of each source per query, ranked anew: rows query_id, doc_id, rank."""
    rows = hits if excluded is None else hits.where(F.col("doc_id") != F.coalesce(F.col(excluded), F.lit("")))
    first = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long")).drop("at")


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + F.lit(1.0))


def rank_metrics(ranked: DataFrame, qrels: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """Per query with positives: recall, nDCG, MRR, any and all evidence at k.

    `ranked` has query_id, doc_id, rank; `qrels` query_id, doc_id, gain (> 0).
    """
    worth = (lambda g: F.pow(F.lit(2.0), g) - 1.0) if exponential else (lambda g: g.cast("double"))
    relevant = qrels.where(F.col("gain") > 0)
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    ideal = (
        relevant.withColumn("at", F.row_number().over(best))
        .groupBy("query_id")
        .agg(F.count("*").alias("positives"), F.sum(F.when(F.col("at") <= k, worth(F.col("gain")) * discount(F.col("at")))).alias("idcg"))
    )
    top = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"])
    got = top.groupBy("query_id").agg(F.count("*").alias("found"), F.sum(worth(F.col("gain")) * discount(F.col("rank"))).alias("dcg"), F.min("rank").alias("first"))
    out = ideal.join(got, "query_id", "left")
    found = F.coalesce("found", F.lit(0))
    return out.select(
        "query_id",
        (found / F.col("positives")).alias("recall"),
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"),
        (found > 0).cast("double").alias("any_evidence"),
        (found == F.col("positives")).cast("double").alias("all_evidence"),
    )


def ranking_figures(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: recall at each cut, nDCG at the last, and MRR over the whole ranking; all null for a
    query without positives. Gains of 0 and less are no positives."""
    relevant = qrels.where(F.col("gain") > 0)
    last = cuts[-1]
    whole = ranked.join(relevant, ["query_id", "doc_id"])
    found = whole.groupBy("query_id").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in cuts),
        F.sum(F.when(F.col("rank") <= last, F.col("gain") * discount(F.col("rank")))).alias("dcg"),
        F.min("rank").alias("first"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    ideal = relevant.withColumn("at", F.row_number().over(best)).groupBy("query_id").agg(
        F.count("*").alias("positives"), F.sum(F.when(F.col("at") <= last, F.col("gain") * discount(F.col("at")))).alias("idcg")
    )
    out = queries.select("query_id").join(ideal, "query_id", "left").join(found, "query_id", "left")
    has = F.col("positives").isNotNull()
    zero = lambda c: F.when(has, F.coalesce(c, F.lit(0.0)))
    recalls = [zero(F.col(f"found_{k}") / F.col("positives")).alias(f"recall_{k}") for k in cuts]
    return out.select("query_id", *recalls, zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(F.lit(1.0) / F.col("first")).alias("mrr"))


def answerable(queries: DataFrame, qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """Queries that a retrieval run is judged on: with positives, all of which are in the corpus.
    Questions to abstain from have none, unresolved ones name documents that are not there."""
    relevant = qrels.where(F.col("gain") > 0).select("query_id", "doc_id")
    broken = relevant.join(docs.select("doc_id"), "doc_id", "left_anti").select("query_id")
    return queries.join(relevant.select("query_id"), "query_id", "left_semi").join(broken, "query_id", "left_anti")


def answer_summary(answers: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Per category and overall: questions, mean score and how many are right in full."""
    return answers.rollup(by).agg(F.count("*").alias("questions"), F.avg(score).alias("qa_score"), F.count_if(F.col(score) >= 1.0).alias("correct"))


def means(metrics: DataFrame, *by: str) -> DataFrame:
    """Macro means overall and by category in one pass."""
    columns = [F.avg(c).alias(c) for c in ("recall", "ndcg", "mrr", "any_evidence", "all_evidence")]
    return metrics.rollup(*by).agg(F.count("*").alias("queries"), *columns)


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99), *by: str) -> DataFrame:
    """Percentiles at index ceil(n * p) - 1 of the sorted values."""
    picks = [F.expr(f"cast(percentile_disc({p}) within group (order by {column}) as double)").alias(f"p{round(p * 100)}") for p in shares]
    return values.groupBy(*by).agg(*picks)


def rank_pick(values: DataFrame, column: str, share: float, by: str) -> DataFrame:
    """Percentile at index ceil((n - 1) * share): the exact percentile's upper neighbour.

    The counts per distinct value are aggregated first, so the window sees each value once.
    """
    counts = values.groupBy(by, column).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy(column)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(by))})
    wanted = F.ceil((F.col("all") - 1) * F.lit(share))
    return ranked.where(F.col("upto") > wanted).groupBy(by).agg(F.min(column).cast("double").alias("value"))


def first_per_group(rows: DataFrame, group: str, order: str, n: int = 2) -> DataFrame:
    window = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("at", F.row_number().over(window)).where(F.col("at") <= n).withColumn("at", F.col("at").cast("long"))


MAX_CLUSTERS = 100_000


def bootstrap_interval(rows: DataFrame, cluster: str, score: str, samples: int = 2000, seed: int = 20261004) -> tuple[float, float] | None:
    """95 % interval of the mean, clusters drawn with replacement; None below two clusters.

    Only sums and counts per cluster reach the driver, in cluster order, of MAX_CLUSTERS at most.
    """
    groups = rows.groupBy(cluster).agg(F.sum(score).alias("s"), F.count("*").alias("n")).orderBy(cluster).limit(MAX_CLUSTERS + 1).collect()
    if len(groups) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters; draw them in Spark")
    if len(groups) < 2:
        return None
    rng, found = random.Random(seed), []
    for _ in range(samples):
        drawn = [rng.choice(groups) for _ in groups]
        found.append(sum(g["s"] for g in drawn) / sum(g["n"] for g in drawn))
    found.sort()
    return float(found[samples * 25 // 1000 - 1]), float(found[samples * 975 // 1000 - 1])


def uncovered(saved: DataFrame, source: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """Rows on one side only, or with other values: empty when a saved run covers its source."""
    a = saved.select(*key, F.struct(*compared).alias("a"))
    b = source.select(*key, F.struct(*compared).alias("b"))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def foreign_ranks(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked documents that are not in their query's scope."""
    return ranked.join(docs.select("doc_id", "scope"), ["doc_id", "scope"], "left_anti")


def run_scores(ranked: DataFrame, k: int) -> DataFrame:
    """Scores that fall with the rank, for an independent evaluator."""
    return ranked.withColumn("run_score", F.lit(k) - F.col("rank") + 1)


def context_blocks(hits: DataFrame, budget: int, top_sources: int) -> DataFrame:
    """Per query the blocks that fit a budget of words, the last one cut: rows with `used` and `words_kept`.

    Words stand in for tokens. At most `top_sources` sources count, in order of their first hit.
    """
    first = Window.partitionBy("query_id", "source_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    ranked = hits.withColumn("first", F.min("rank").over(first))
    ranked = ranked.withColumn("source_at", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("source_at") <= top_sources)
    text = F.concat(F.lit("\n[Source "), "source_id", F.lit(", part "), F.col("part").cast("string"), F.lit("]\n"), F.col("content"))
    sized = ranked.withColumn("text", text).withColumn("words", F.regexp_count("text", F.lit(r"\S+")).cast("long"))
    used = sized.withColumn("used", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return used.where(F.col("used") < budget).withColumn("words_kept", F.least(F.col("words"), F.lit(budget) - F.col("used")))


def rates(rows: DataFrame, *flags: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in flags))
