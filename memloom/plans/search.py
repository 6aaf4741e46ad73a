"""BM25 search and literal recall as declarative plans.

Without a stored index (see `stored`) a search scans the memories twice: once for the corpus figures of the query's terms (partial
aggregates, one row a term), once to score. Terms are looked up in each row's word array, so no
token is ever shuffled; the plan (72 terms at most) is literal in the second scan, behind the
filters, which reach the files.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import live, saturation
from ..functions.stem import may_share_stem, stem
from ..functions.text import contains_all, literal_terms, plain_words, stem_counts, words

MAX_TERMS, MAX_EXPANSIONS, EXPANSION_WEIGHT = 64, 8, 0.25
MAX_QUERY_BYTES = 16_384
#: Pairs of words that stand for each other when a query is expanded.
SYNONYMS = (
    ("ban", "prohibit"),
    ("allow", "permit"),
    ("cost", "expense"),
    ("danger", "risk"),
    ("benefit", "advantage"),
    ("harm", "damage"),
    ("buy", "purchase"),
    ("job", "employment"),
)


@dataclass(frozen=True)
class Filters:
    topic: str | None = None
    tag: str | None = None
    from_ms: int | None = None
    to_ms: int | None = None

    def column(self) -> Column:
        out = F.lit(True)
        if self.topic is not None:
            out = out & (F.col("topic") == self.topic.strip().lower())
        if self.tag is not None:
            out = out & F.array_contains("tags", self.tag.strip().lower())
        if self.from_ms is not None:
            out = out & (F.col("occurred_at_ms") >= self.from_ms)
        if self.to_ms is not None:
            out = out & (F.col("occurred_at_ms") <= self.to_ms)
        return out


@dataclass(frozen=True)
class SearchQuery:
    text: str
    filters: Filters = Filters()
    limit: int = 20
    expansion_terms: tuple[str, ...] = ()
    expand: bool = False
    after: tuple[float, str] | None = None  # score and key of the last hit seen
    stemmed: bool = True

    def validate(self) -> None:
        if not self.text.strip() or len(self.text.encode()) > MAX_QUERY_BYTES:
            raise ValueError("query must have 1..16384 bytes")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must be 1..100")
        if len(self.expansion_terms) > 8 or any(not t.isalnum() or len(t.encode()) > 64 for t in self.expansion_terms):
            raise ValueError("at most 8 alphanumeric expansion terms of 64 bytes")
        if None not in (self.filters.from_ms, self.filters.to_ms) and self.filters.from_ms > self.filters.to_ms:
            raise ValueError("the time range is reversed")

    def terms(self) -> Counter[str]:
        found = plain_words(self.text.strip())
        return Counter(map(stem, found)) if self.stemmed else Counter(found)

    def expansions(self) -> list[str]:
        own, out = self.terms(), set()
        norm = stem if self.stemmed else str
        out |= {norm(t.lower()) for t in self.expansion_terms}
        for a, b in SYNONYMS if self.expand else ():
            a, b = norm(a), norm(b)
            out |= {y for x, y in ((a, b), (b, a)) if x in own}
        return sorted(out - set(own))


def with_terms(memories: DataFrame, stemmed: bool = True, text: str = "content") -> DataFrame:
    """Adds `counts` (array of term and tf; of plain words one entry each) and `doc_len`."""
    base = memories.withColumn("words_", words(F.col(text)))
    base = base.withColumn("doc_len", F.size("words_").cast("long"))
    if stemmed:
        return base.withColumn("counts", stem_counts("words_")).drop("words_")
    return base.withColumn("counts", F.transform("words_", lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("tf")))).drop("words_")


def _with_hits(memories: DataFrame, terms: list[str], stemmed: bool) -> DataFrame:
    """Adds `doc_len` and `hits`: the entries (term, tf) of the given terms only. Only words that can
    have one of their stems are stemmed at all."""
    base = memories.withColumn("words_", words(F.coalesce("content", F.lit("")))).withColumn("doc_len", F.size("words_").cast("long"))
    if not terms:
        return base.withColumn("hits", F.array().cast("array<struct<term:string,tf:long>>")).drop("words_")
    if not stemmed:
        found = F.filter("words_", lambda w: w.isin(*terms))
        return base.withColumn("hits", F.transform(found, lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("tf")))).drop("words_")
    starts, others = may_share_stem(terms)
    near = F.filter("words_", lambda w: F.substring(w, 1, 2).isin(*starts) | F.substring(w, 1, 1).isin(*starts) | w.isin(*others, ""))
    return base.withColumn("hits", F.filter(stem_counts(near), lambda c: c["term"].isin(*terms))).drop("words_")


def corpus_stats(indexed: DataFrame) -> DataFrame:
    return indexed.agg(F.count("*").alias("docs"), F.sum("doc_len").cast("long").alias("tokens"))


@dataclass(frozen=True)
class Plan:
    """A query's terms against a corpus: at most 64 own terms and 8 expansions, with their weights."""

    docs: int
    tokens: int
    weights: dict[str, float]
    df: dict[str, int]
    query_terms: int

    @property
    def mean_len(self) -> float:
        return self.tokens / self.docs


def plan_query(memories: DataFrame, query: SearchQuery) -> Plan:
    """One scan gives the corpus figures and the terms' document frequencies, a row for each; the
    query's 16 KiB bound them. The weights follow on the driver."""
    query.validate()
    counts, extra = query.terms(), query.expansions()
    held = _with_hits(memories, [*counts, *extra], query.stemmed)
    rows = F.concat(F.array(F.lit("")), F.array_distinct(F.transform("hits", lambda c: c["term"])))  # "" stands for the row
    found = held.select(F.explode(rows).alias("term"), "doc_len").groupBy("term").agg(F.count("*").alias("df"), F.sum("doc_len").alias("tokens")).collect()
    df = {r["term"]: r["df"] for r in found}
    docs, tokens = df.pop("", 0), next((r["tokens"] for r in found if r["term"] == ""), 0) or 0
    return weighed_plan(query, df, docs, tokens)


def weighed_plan(query: SearchQuery, df: dict[str, int], docs: int, tokens: int) -> Plan:
    """The terms that count, by their document frequencies."""
    counts, extra = query.terms(), query.expansions()
    idf = {t: math.log(1 + (docs - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    salient = len(counts) > MAX_TERMS
    own = {t: idf[t] * (math.sqrt(n) if salient else 1.0) for t, n in counts.items() if t in df}
    kept = sorted(own, key=lambda t: (-own[t], t.encode()))[:MAX_TERMS]
    weights = {t: own[t] for t in kept} | {t: idf[t] * EXPANSION_WEIGHT for t in [t for t in extra if t in df][:MAX_EXPANSIONS]}
    return Plan(docs, tokens, weights, {t: df[t] for t in weights}, len(counts))


def scored(memories: DataFrame, plan: Plan, stemmed: bool = True) -> DataFrame:
    """`memories` with `score`; rows without a planned term are left out. The plan's weights are literals."""
    held = _with_hits(memories, list(plan.weights), stemmed).where(F.size("hits") > 0)
    weights = F.create_map(*(x for t, w in plan.weights.items() for x in (F.lit(t), F.lit(w)))) if plan.weights else F.create_map(F.lit(""), F.lit(0.0))
    mean = F.lit(plan.mean_len if plan.docs else 1.0)

    def part(term: Column) -> Column:
        tf = F.aggregate(F.filter("hits", lambda c: c["term"] == term), F.lit(0).cast("long"), lambda s, c: s + c["tf"]).cast("double")
        return F.element_at(weights, term) * saturation(tf, F.col("doc_len").cast("double"), mean)

    # in the order of terms, so that equal documents have equal scores to the last bit
    terms = F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["term"])))
    return held.withColumn("score", F.aggregate(terms, F.lit(0.0), lambda s, t: s + part(t))).drop("hits", "doc_len")


def search(memories: DataFrame, query: SearchQuery, now_ms: int, ahead: int = 0) -> DataFrame:
    """Hits by score, then key, and `ahead` more. Corpus figures cover all rows; filters only choose among
    the scored."""
    rows = memories.where(live(F.col("expires_at_ms"), now_ms) & query.filters.column())
    hits = scored(rows, plan_query(memories, query), query.stemmed)
    if query.after is not None:
        score, key = query.after
        hits = hits.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("key") > key)))
    return hits.orderBy(F.desc("score"), "key").limit(query.limit + ahead)


def search_counters(memories: DataFrame, query: SearchQuery) -> DataFrame:
    """One row: query_terms, selected_terms, postings_scanned, index_reads, truncated, scored_candidates."""
    plan = plan_query(memories, query)
    postings = sum(plan.df.values())
    return scored(memories, plan, query.stemmed).agg(
        F.lit(plan.query_terms).cast("long").alias("query_terms"),
        F.lit(len(plan.weights)).cast("long").alias("selected_terms"),
        F.lit(postings).cast("long").alias("postings_scanned"),
        F.lit(postings + len(plan.weights)).cast("long").alias("index_reads"),
        F.lit(False).alias("truncated"),
        F.count("*").alias("scored_candidates"),
    )


def recall(memories: DataFrame, now_ms: int, filters: Filters = Filters(), query: str = "", limit: int = 20, after: tuple[int, str] | None = None, ahead: int = 0) -> DataFrame:
    """Live memories by event time, newest first, then key descending, and `ahead` more."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1..100")
    rows = memories.where(live(F.col("expires_at_ms"), now_ms) & filters.column() & contains_all(F.col("content"), literal_terms(query)))
    if after is not None:
        at, key = after
        rows = rows.where((F.col("occurred_at_ms") < at) | ((F.col("occurred_at_ms") == at) & (F.col("key") < key)))
    return rows.orderBy(F.desc("occurred_at_ms"), F.desc("key")).limit(limit + ahead)


def recall_candidates(memories: DataFrame, now_ms: int, filters: Filters, query: str, candidates: int, after: tuple[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bounded recall: of the next `candidates` labelled memories the hits, and the last one looked at
    (one row, from which the next page goes on). A page may be empty and still have a next one."""
    looked = recall(memories, now_ms, filters, "", 1, after, ahead=candidates - 1)
    return looked.where(contains_all(F.col("content"), literal_terms(query))), looked.orderBy("occurred_at_ms", "key").limit(1)


def byte_page(hits: DataFrame, order: list[Column], size: Column, max_bytes: int) -> DataFrame:
    """The leading hits whose sizes fit together; `hits` is a page already, of 100 rows at most."""
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", running).where(F.col("used") <= max_bytes)
