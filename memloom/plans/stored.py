"""A stored inverted index: every document is tokenised once, a search reads its terms' postings only.

Postings (term, key, tf, doc_len) lie in folders by term bucket, sorted by term, so that a query's
terms prune folders and row groups. Each document has one more row in a bucket of its own, which gives
the corpus figures. Words are kept as they are; the vocabulary has each word's stem, so that stems are
computed once a word and a stemmed query looks up the words that share its stems.

An update writes a segment (its generation is the folder) and the keys that it replaces or removes;
rows of a key that a later segment names are passed over. The generation names the state that a
cursor belongs to.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import idf, live, saturation
from ..functions.text import stem_en, words
from .search import MAX_TERMS, Plan, SearchQuery, weighed_plan

#: Bytes of text that a bucket stands for, and buckets at most.
BUCKET_BYTES = 64 << 20
MAX_BUCKETS = 4096
#: Bucket of the documents' own rows.
DOCUMENTS = -1
#: Words that a scan gets as literals; beyond, they are joined.
MAX_LITERALS = 10_000
#: Rows of a batch's plan (about 60 bytes each) that may be broadcast.
BROADCAST_PLAN = 500_000
_POSTING = "term string, key string, doc_len long, tf long, gen long, bucket int"
_WORD = "term string, stem string, gen long"


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int
    #: Files of a bucket: a term of very many documents is written by as many tasks.
    parts: int = 1
    generation: int = 0
    replaced: bool = False

    @classmethod
    def build(cls, memories: DataFrame, path: str, text_bytes: int | None = None) -> SearchIndex:
        """Index of rows with key and content; keys are unique. `text_bytes` sets the number of buckets."""
        spark = memories.sparkSession
        if text_bytes is None:
            text_bytes = memories.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        cores = spark.sparkContext.defaultParallelism
        buckets = max(cores, min(MAX_BUCKETS, -(-text_bytes // BUCKET_BYTES)))
        index = cls(spark, path.rstrip("/"), buckets, max(1, -(-text_bytes // (buckets * BUCKET_BYTES))))
        index._write(memories)
        return index

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(self.buckets)).cast("int")

    def _write(self, memories: DataFrame) -> None:
        own = memories.select("key", words(F.coalesce("content", F.lit(""))).alias("w")).select("key", F.size("w").cast("long").alias("doc_len"), F.concat(F.array(F.lit("")), "w").alias("w"))
        # the outer form: the other one repeats the words' expression in a filter of its own
        tokens = own.select("key", "doc_len", F.explode_outer("w").alias("term"))
        posted = tokens.groupBy("term", "key", "doc_len").agg(F.count("*").alias("tf"))
        bucket = F.when(F.col("term") == "", F.lit(DOCUMENTS)).otherwise(self._bucket(F.col("term")))
        part = F.pmod(F.xxhash64("key"), F.lit(self.parts))
        dealt = posted.withColumn("bucket", bucket).repartition(self.buckets * self.parts, F.col("bucket"), part).sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/gen={self.generation}")
        terms = self._segment().where((F.col("gen") == self.generation) & (F.col("bucket") != DOCUMENTS)).select("term").distinct()
        vocabulary = terms.select("term", stem_en("term").alias("stem"))
        vocabulary.repartition(max(1, self.buckets // 8), "stem").sortWithinPartitions("stem").write.mode("overwrite").parquet(f"{self.path}/words/gen={self.generation}")

    def _segment(self) -> DataFrame:
        return self.spark.read.schema(_POSTING).option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings").where(F.col("gen") <= self.generation)

    def update(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> SearchIndex:
        """The index behind `changed` (key, content; new or replaced) and `removed` (key) memories."""
        after = replace(self, generation=self.generation + 1, replaced=True)
        gone = [df.select("key") for df in (changed, removed) if df is not None]
        if not gone:
            return self
        keys = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
        keys.distinct().write.mode("overwrite").parquet(f"{self.path}/gone/gen={after.generation}")
        empty = self.spark.createDataFrame([], "key string, content string")
        after._write(empty if changed is None else changed)
        return after

    def rows(self) -> DataFrame:
        """Valid postings and documents' rows: term, key, doc_len, tf, bucket."""
        every = self._segment()
        if not self.replaced:
            return every.drop("gen")
        gone = self.spark.read.schema("key string, gen long").parquet(f"{self.path}/gone").where(F.col("gen") <= self.generation)
        last = gone.groupBy("key").agg(F.max("gen").alias("last"))
        return every.join(last, "key", "left").where(F.col("last").isNull() | (F.col("gen") >= F.col("last"))).drop("gen", "last")

    def figures(self) -> tuple[int, int]:
        """Documents and tokens."""
        row = self.rows().where(F.col("bucket") == DOCUMENTS).agg(F.count("*").alias("docs"), F.sum("doc_len").alias("tokens")).first()
        return row["docs"], row["tokens"] or 0

    def stems_of(self, terms: list[str]) -> dict[str, str]:
        """The words that have these stems, with them."""
        known = self.spark.read.schema(_WORD).parquet(f"{self.path}/words").where((F.col("gen") <= self.generation) & F.col("stem").isin(*terms))
        return {r["term"]: r["stem"] for r in known.select("term", "stem").distinct().collect()}

    def postings(self, terms: list[str], stemmed: bool) -> DataFrame:
        """Rows (term, key, doc_len, tf) of the given terms, or stems; reads no other buckets."""
        stems = self.stems_of(terms) if stemmed else {t: t for t in terms}
        wanted = sorted(stems)
        if len(wanted) <= MAX_LITERALS:
            buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted})
            found = self.rows().where(F.col("bucket").isin(*buckets) & F.col("term").isin(*wanted))
        else:
            found = self.rows().where(F.col("bucket") != DOCUMENTS).join(self.spark.createDataFrame([(t,) for t in wanted], "term string"), "term")
        found = found.drop("bucket")
        if all(t == s for t, s in stems.items()):
            return found
        named = F.create_map(*(F.lit(x) for pair in sorted(stems.items()) for x in pair))
        return found.withColumn("term", F.element_at(named, F.col("term"))).groupBy("term", "key", "doc_len").agg(F.sum("tf").alias("tf"))

    def plan(self, query: SearchQuery) -> Plan:
        query.validate()
        counts, extra = query.terms(), query.expansions()
        found = self.postings([*counts, *extra], query.stemmed).groupBy("term").agg(F.count("*").alias("df")).collect()
        docs, tokens = self.figures()
        return weighed_plan(query, {r["term"]: r["df"] for r in found}, docs, tokens)

    def scores(self, plan: Plan, stemmed: bool) -> DataFrame:
        """Rows (key, score). Parts are summed in the order of their terms, so that scores are the same
        in every run; a key has 72 of them at most."""
        if not plan.weights:
            return self.spark.createDataFrame([], "key string, score double")
        weights = F.create_map(*(x for t, w in plan.weights.items() for x in (F.lit(t), F.lit(w))))
        part = F.element_at(weights, F.col("term")) * saturation(F.col("tf").cast("double"), F.col("doc_len").cast("double"), F.lit(plan.mean_len))
        held = self.postings(list(plan.weights), stemmed).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"))
        return held.select("key", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))

    def search(self, memories: DataFrame, query: SearchQuery, now_ms: int, ahead: int = 0) -> DataFrame:
        """Hits among the live and filtered memories, by score, then key, and `ahead` more."""
        chosen = memories.where(live(F.col("expires_at_ms"), now_ms) & query.filters.column())
        hits = chosen.join(self.scores(self.plan(query), query.stemmed), "key")
        if query.after is not None:
            score, key = query.after
            hits = hits.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("key") > key)))
        return hits.orderBy(F.desc("score"), "key").limit(query.limit + ahead)

    def counters(self, query: SearchQuery) -> DataFrame:
        """One row: query_terms, selected_terms, postings_scanned, index_reads, truncated, scored_candidates."""
        plan = self.plan(query)
        scanned = sum(plan.df.values())
        figures = {"query_terms": plan.query_terms, "selected_terms": len(plan.weights), "postings_scanned": scanned, "index_reads": scanned + len(plan.weights)}
        columns = [F.lit(v).cast("long").alias(k) for k, v in figures.items()]
        return self.scores(plan, query.stemmed).agg(*columns, F.lit(False).alias("truncated"), F.count("*").alias("scored_candidates"))

    def batch(self, queries: DataFrame, limit: int) -> DataFrame:
        """Top hits of many queries (query_id, text) over plain words: rows query_id, key, score and rank.

        The queries' weighed terms are written; while they are few they go to the postings, which are
        read once and not moved. What is shuffled is a partial sum per query and document.
        """
        docs, tokens = self.figures()
        asked = queries.select("query_id", F.explode_outer(words(F.col("text"))).alias("term")).where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("n"))
        posted = self.rows().where(F.col("bucket") != DOCUMENTS)
        terms = posted.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        n_words = F.count("*").over(Window.partitionBy("query_id"))
        salient = F.when(F.col("n_words") > MAX_TERMS, F.sqrt(F.col("n").cast("double"))).otherwise(F.lit(1.0))
        weighed = asked.withColumn("n_words", n_words).join(terms, "term").withColumn("weight", idf(F.lit(docs), F.col("df")) * salient)
        best = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
        plan = weighed.withColumn("at", F.row_number().over(best)).where(F.col("at") <= MAX_TERMS).select("query_id", "term", "weight")
        path = f"{self.path}/plans/{uuid.uuid4().hex}"  # goes with the index
        plan.write.parquet(path)
        plan = self.spark.read.parquet(path)
        few = plan.count() <= BROADCAST_PLAN
        part = F.col("weight") * saturation(F.col("tf").cast("double"), F.col("doc_len").cast("double"), F.lit(tokens / docs if docs else 1.0))
        scores = posted.join(F.broadcast(plan) if few else plan, "term").groupBy("query_id", "key").agg(F.round(F.sum(part), 9).alias("score"))
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
        return ranked.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
