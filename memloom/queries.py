"""Query catalogue over the driver tables, with the same in SQL.

Documents stand in for memories (key doc/<id>, topic is the language, one tag, the source), events
for an operation log, conversations for sessions, benchmark passages for search queries.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar
from .functions.text import STOP_WORDS, fixed_chunks, keyword_query, labels, trim_space, words
from .operators import admission, checkpoints, evaluation, index, ledger, lifecycle, oplog, records
from .plans.search import Filters, SearchQuery, byte_page, recall, recall_candidates, with_terms
from .plans.stored import SearchIndex
from .round_trips import ROUND_TRIPS
from .sources import readers, sinks
from .sources.config import Namespace
from .streaming import folds

BASE_MS = 1_760_000_000_000
NOW_MS = 1_705_708_800_000  # 2024-01-20, within the events
DAY_MS = 86_400_000
LATER_MS = NOW_MS + 15 * DAY_MS  # behind the events, when records have expired


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores if the table has fewer splits than those, as one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def millis(column: str) -> Column:
    """Epoch milliseconds of a timestamp with or without zone, read as UTC."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents"))
    at = F.lit(BASE_MS) + F.col("doc_id")
    return d.select(
        F.lit("knowledge").alias("namespace"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"),
        F.col("text").alias("content"),
        F.col("lang").alias("topic"),
        F.array("source").alias("tags"),
        at.alias("occurred_at_ms"),
        at.alias("written_at_ms"),
        F.lit(None).cast("long").alias("expires_at_ms"),
        (F.col("doc_id") + 1).alias("revision"),
    )


def event_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as versions of records: an error's record lives a day, a purchase's forever."""
    e = read(spark, sf_dir, "events") if events is None else events
    written = millis("ts")
    life = F.when(F.col("event_type") == "purchase", F.lit(None)).when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(10))
    return e.select(
        F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("namespace"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").cast("binary").alias("value"),
        (F.col("event_id") + 1).alias("revision"),
        written.alias("written_at_ms"),
        (written + life * DAY_MS).alias("expires_at_ms"),
        F.col("event_id").alias("inserted"),
        "event_type",
    )


def _sql_words(column: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(string_split_regex(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND length(w) <= 64 AND NOT list_contains([{stop}], w))"


_MEM = f"""m AS (SELECT 'doc/' || doc_id AS key, text AS content, lang AS topic, source AS tag, {BASE_MS} + doc_id AS occurred_at_ms, doc_id + 1 AS revision FROM documents)"""
_LOG = f"""l AS (SELECT 'n' || (user_id % 4) AS namespace, 'user/' || user_id AS key, props AS value, event_id + 1 AS revision, epoch_us(ts) // 1000 AS written_at_ms,
 epoch_us(ts) // 1000 + CASE event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN 1 ELSE 10 END * {DAY_MS} AS expires_at_ms, event_id AS inserted, event_type FROM events)"""
_LATEST = f"""{_LOG}, r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY revision DESC) = 1)"""
_TOKENS = f"""{_MEM}, d AS (SELECT m.*, {_sql_words("content")} AS words FROM m), x AS (SELECT key, len(words) AS doc_len, unnest(words) AS w FROM d)"""
_POST = f"""{_TOKENS}, p AS (SELECT key, doc_len, w AS term, count(*) AS tf FROM x GROUP BY ALL), st AS (SELECT count(*) AS docs, sum(len(words)) AS tokens FROM d)"""


def _sql_scores(terms: dict[str, float], case: str = "w") -> str:
    """Scores s(key, score) of terms with weight factors; `case` maps a word to its term."""
    held = ", ".join(f"('{t}', {f!r}e0)" for t, f in terms.items())
    return f"""{_TOKENS}, st AS (SELECT count(*) AS docs, sum(len(words)) AS tokens FROM d),
 p AS (SELECT key, doc_len, {case} AS term, count(*) AS tf FROM x GROUP BY ALL), q(term, f) AS (VALUES {held}),
 t AS (SELECT p.term, f, count(*) AS df FROM p JOIN q ON p.term = q.term GROUP BY ALL),
 g AS (SELECT term, f * ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) AS weight FROM t, st),
 s AS (SELECT key, round(sum(weight * (tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * doc_len / (tokens::DOUBLE / docs))))), 9) AS score FROM p JOIN g USING (term), st GROUP BY key)"""


QUERY = "tion heat, thing!"
TERMS = {"tion": 1.0, "heat": 1.0, "thing": 1.0}
#: Words of the driver's tables that share the stem of a query word.
STEM_FORMS = {
    "tion": "tion tioned tionedly tiones tioning tioningly tionly tionlyed tionlying tionlyedly tionlyingly".split(),
    "heat": "heat heated heates heating heatly heatedly heatingly heatlyed heatlying".split(),
}
_CASE = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(w) for w in f)}) THEN '{t}'" for t, f in STEM_FORMS.items()) + " ELSE w END"


_indexes: dict[tuple, SearchIndex] = {}


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored index of the documents, written by the first search of a session over these files."""
    files = sinks.file_states(spark, read(spark, sf_dir, "documents").inputFiles())
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _indexes:
        path = sinks.shared_path(spark, "index")
        atexit.register(sinks.remove, spark, path)
        _indexes[key] = SearchIndex.build(memories(spark, sf_dir), path)
    return _indexes[key]


def _hits(q: SearchQuery, spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_index(spark, sf_dir).search(memories(spark, sf_dir), q, NOW_MS).select("key", F.round("score", 9).alias("score"))


def s01_tokens_per_doc(spark, sf):
    return with_terms(memories(spark, sf), stemmed=False).select("key", "doc_len")


def s02_term_df(spark, sf):
    return index.term_frequencies(search_index(spark, sf).rows().where("term <> ''"))


def s03_corpus_stats(spark, sf):
    return index.statistics(memories(spark, sf))


def s05_bm25_all(spark, sf):
    own = search_index(spark, sf)
    return own.scores(own.plan(SearchQuery(QUERY, stemmed=False)), stemmed=False).select("key", F.round("score", 9).alias("score"))


def s09_long_query(spark, sf):
    """A query of over 64 words: weights rise with the root of a word's count, 64 terms are kept."""
    text = " ".join(r["text"] for r in read(spark, sf, "benchmark").where("item_id < 5").orderBy("item_id").collect())
    return _hits(SearchQuery(text, stemmed=False), spark, sf)


def s10_page_two(spark, sf):
    """The page behind the first one's last hit."""
    q = SearchQuery(QUERY, limit=10, stemmed=False)
    last = search_index(spark, sf).search(memories(spark, sf), q, NOW_MS).select("score", "key").collect()[-1]
    return _hits(SearchQuery(QUERY, limit=10, stemmed=False, after=(last["score"], last["key"])), spark, sf)


def s11_batch_search(spark, sf):
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search_index(spark, sf).batch(queries, 10).select("query_id", "key", "score", "rank")


def s12_counters(spark, sf):
    return search_index(spark, sf).counters(SearchQuery(QUERY, stemmed=False))


def s13_index_update(spark, sf):
    """Document frequencies behind an update: every fifth document has a new text, others are removed."""
    m = memories(spark, sf)
    number = F.col("revision") - 1
    changed = m.where(number % 5 == 0).withColumn("content", F.concat(F.lit("Fresh words of "), "topic"))
    after = search_index(spark, sf).update(changed, m.where(number % 7 == 0))
    return index.term_frequencies(after.rows().where("term <> ''"))


def r05_recall_bytes(spark, sf):
    page = recall(memories(spark, sf), NOW_MS, Filters(topic="en"), limit=100)
    return byte_page(page, [F.desc("occurred_at_ms"), F.desc("key")], F.octet_length("content"), 16_384).select("key", "occurred_at_ms", F.col("used").cast("long").alias("used"))


def r06_recall_bounded(spark, sf):
    """Hits among the next 150 candidates, and the key that the following page goes on from."""
    hits, last = recall_candidates(memories(spark, sf), NOW_MS, Filters(topic="en"), "heat", 150)
    return hits.select("key", "occurred_at_ms", last.select("key").scalar().alias("last_key"))


def _recall(filters: Filters, query: str = "", after=None, limit: int = 20):
    return lambda spark, sf: recall(memories(spark, sf), NOW_MS, filters, query, limit, after).select("key", "topic", "occurred_at_ms")


def m01_admission(spark, sf):
    m = memories(spark, sf).withColumn("metadata", F.lit(None).cast("string"))
    return admission.normalised(m).select("key", "error_code")


def m02_index_entries(spark, sf):
    return admission.index_entries(memories(spark, sf)).groupBy("kind", "label").agg(F.count("*").alias("n"), F.max("occurred_at_ms").alias("newest_ms"))


def m03_labels(spark, sf):
    raw = F.array(F.concat(F.lit("\t "), F.upper("source")), "lang", F.lower("lang"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(labels(raw), ",").alias("tags"), trim_space(F.concat(F.lit("\t "), "lang", F.lit(" \n"))).alias("topic"))


def k01_list_prefix(spark, sf):
    return records.list_page(records.latest(event_log(spark, sf)), "n1", "user/1", NOW_MS, "user/101", 50)


def k02_get_live(spark, sf):
    return records.get(records.latest(event_log(spark, sf)), "n1", "user/5", NOW_MS).select("namespace", "key", "revision", "expires_at_ms")


def k03_live_at(spark, sf):
    live = records.compacted(records.latest(event_log(spark, sf)), NOW_MS)
    return live.groupBy("namespace").agg(F.count("*").alias("n"), F.max("revision").alias("revision"))


def k04_latest_per_key(spark, sf):
    return records.latest(event_log(spark, sf)).select("namespace", "key", "revision", "event_type")


def k05_usage(spark, sf):
    return records.usage(records.latest(event_log(spark, sf)))


def k06_expired_batch(spark, sf):
    return records.expired_batch(records.latest(event_log(spark, sf)), LATER_MS, 25).select("namespace", "key", "expires_at_ms", "revision")


def k07_fifo_kept(spark, sf):
    return records.fifo_kept(records.latest(event_log(spark, sf)), 20, 170).select("namespace", "key", "inserted")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on records: views put, clicks create only, errors delete, purchases
    expect a revision, signups clean up."""
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("n"), (F.col("user_id") % 4).cast("string")).alias("namespace"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"),
        F.when(kind == "error", "delete").when(kind == "signup", "cleanup").otherwise("put").alias("op"),
        F.col("props").cast("binary").alias("value"),
        F.when(kind == "view", F.lit(86_400)).when(kind == "signup", F.lit(5)).cast("long").alias("ttl_seconds"),
        F.when(kind == "click", "absent").when(kind == "purchase", (F.col("event_id") % 7 + 1).cast("string")).alias("condition"),
        millis("ts").alias("now_ms"),
    )


POLICY = Namespace("events", max_key_bytes=64, max_value_bytes=4096, max_entries=30, max_total_bytes=1 << 20)
PLAIN = Namespace("events", max_key_bytes=64, max_value_bytes=4096, max_entries=1 << 30, max_total_bytes=1 << 40)


def k08_put_fold(spark, sf):
    return oplog.fold_outcomes(operations(spark, sf), POLICY).withColumn("evicted", F.array_join("evicted", ","))


def k09_puts_and_deletes(spark, sf):
    """Records left by unconditional puts and deletes."""
    ops = operations(spark, sf).where("op != 'cleanup'").withColumns({"condition": F.lit("any"), "ttl_seconds": F.lit(None).cast("long")})
    return oplog.plain_records(ops, PLAIN).select("namespace", "key", F.col("value").cast("string").alias("value"), "revision")


def k10_grants(spark, sf):
    grants = spark.createDataFrame([("ann", "n1", "get"), ("ann", "n2", "get"), ("ann", "n3", "put"), ("bob", "n0", "get")], "principal string, namespace string, operation string")
    own = records.authorised(records.latest(event_log(spark, sf)), grants, "ann")
    return own.groupBy("namespace").agg(F.count("*").alias("n"))


def _checkpoint_log(spark, sf):
    c = read(spark, sf, "conversations").where("role = 'assistant'")
    capsule = F.to_json(F.struct(F.lit("go on").alias("goal"), F.col("text").alias("summary"), F.lit("answer").alias("next_action")))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("n", F.row_number().over(order)).withColumn("id", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    # one namespace a conversation, so that a pointer's revision is twice the number of saves
    return rows.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("namespace"),
        F.col("turn").alias("seq"),
        "id",
        F.lit("agent").alias("agent_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        capsule.alias("capsule"),
        F.lit("[]").alias("refs"),
        F.when(F.col("n") > 1, 2 * (F.col("n") - 1)).cast("long").alias("expected_revision"),
    )


def c01_latest_checkpoint(spark, sf):
    return checkpoints.latest_checkpoints(checkpoints.fold_checkpoints(_checkpoint_log(spark, sf))).select("session_id", "id", "revision", "latest_revision")


def _reference_status(spark, sf, refs: DataFrame) -> DataFrame:
    gone = refs.withColumn("key", F.when(F.col("revision") % 50 == 0, F.concat("key", F.lit("-gone"))).otherwise(F.col("key")))
    allowed = spark.createDataFrame([("n0",), ("n1",), ("n2",)], "namespace string")
    return checkpoints.reference_status(gone, records.latest(event_log(spark, sf)), NOW_MS, allowed)


def c02_reference_status(spark, sf):
    """Every log row as a reference."""
    return _reference_status(spark, sf, event_log(spark, sf).select("namespace", "key", "revision"))


def c03_prunable(spark, sf):
    receipts = checkpoints.fold_checkpoints(_checkpoint_log(spark, sf))
    return checkpoints.prunable(receipts.select("namespace", "id"), checkpoints.latest_checkpoints(receipts))


def proposals(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as observations of a user's attribute: the value is rough, so repeats and conflicts occur."""
    e = read(spark, sf_dir, "events") if events is None else events
    at = millis("ts") - F.when(F.col("event_id") % 11 == 0, 3 * DAY_MS).otherwise(F.lit(0))
    none = F.lit(None).cast("long")
    return e.select(
        F.lit("personal").alias("scope"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("attribute"),
        F.col("event_id").alias("seq"),
        F.lit("assert").alias("operation"),
        F.when(F.col("value") > 20, "high").otherwise("low").alias("value"),
        F.lit("fact").alias("kind"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_id"),
        F.col("props").alias("source_text"),
        F.lit("user").alias("source_role"),
        at.alias("occurred_at_ms"),
        none.alias("valid_until_ms"),
        none.alias("expected_revision"),
    )


def l01_receipts(spark, sf):
    return lifecycle.fold_receipts(proposals(spark, sf))


def l02_profile(spark, sf):
    return lifecycle.profile(lifecycle.fold_slots(proposals(spark, sf)), NOW_MS)


def l03_slots(spark, sf):
    return lifecycle.fold_slots(proposals(spark, sf))


def l06_profile_bytes(spark, sf):
    """The profile's leading facts whose JSON fits into 2 KiB."""
    top = lifecycle.profile(lifecycle.fold_slots(proposals(spark, sf)), NOW_MS)
    shown = ("entity", "attribute", "value", "revision")
    return lifecycle.within_bytes(top, lifecycle.newest(), 2048, *shown).select(*shown, "used", "truncated")


def l07_slot_keys(spark, sf):
    return lifecycle.slot_keys(proposals(spark, sf)).select("seq", "slot_key")


def l08_context(spark, sf):
    """Facts that answer a query."""
    return lifecycle.context(lifecycle.fold_slots(proposals(spark, sf)), "high purchase of user", NOW_MS).select("entity", "attribute", F.round("score", 9).alias("score"))


def l10_inspect(spark, sf):
    slots = lifecycle.fold_slots(proposals(spark, sf))
    return lifecycle.inspect(slots, "Personal ", " USER 5", "Click").select("entity", "attribute", "state", "value", "revision")


def l05_proposal_errors(spark, sf):
    p = proposals(spark, sf).withColumn("source_role", F.when(F.col("seq") % 13 == 0, "assistant").otherwise(F.col("source_role")))
    p = p.withColumn("operation", F.when(F.col("seq") % 17 == 0, "correct").when(F.col("seq") % 19 == 0, "guess").otherwise(F.col("operation")))
    return admission.proposal_error(p).groupBy("error_code").agg(F.count("*").alias("n"))


def _grams(text: str) -> tuple[Column, Column]:
    """The words of a text, and the runs of four of a column `w` of them."""
    w = words(F.col(text))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(4)), " "))
    return w, F.when(F.size("w") >= 4, runs)


def _qrels(spark, sf):
    """Documents that hold the first four words of a passage are its positives, gain by language."""
    w, runs = _grams("text")
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w")).where(F.size("w") >= 4)
    b = b.select("query_id", F.array_join(F.slice("w", 1, 4), " ").alias("run"))
    d = spread(read(spark, sf, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("doc_id"), "lang", w.alias("w"))
    held = d.select("doc_id", "lang", F.explode_outer(runs).alias("run"))
    return held.join(b, "run").select("query_id", "doc_id", F.when(F.col("lang") == "en", 2).otherwise(1).alias("gain")).distinct()


_QRELS = f"""bw AS (SELECT item_id AS query_id, {_sql_words("text")} AS w FROM benchmark), b AS (SELECT query_id, array_to_string(w[1:4], ' ') AS run FROM bw WHERE len(w) >= 4),
 dw AS (SELECT 'doc/' || doc_id AS doc_id, lang, {_sql_words("text")} AS w FROM documents),
 dr AS (SELECT DISTINCT doc_id, lang, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS run FROM dw WHERE len(w) >= 4),
 qr AS (SELECT DISTINCT query_id, doc_id, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS gain FROM dr JOIN b USING (run))"""


def _metrics(spark, sf):
    ranked = s11_batch_search(spark, sf).select("query_id", F.col("key").alias("doc_id"), "rank")
    return evaluation.rank_metrics(ranked, _qrels(spark, sf), 10)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


_FIVE = ("recall", "ndcg", "mrr", "any_evidence", "all_evidence")


def e01_rank_metrics(spark, sf):
    return _rounded(_metrics(spark, sf), *_FIVE)


def e02_means(spark, sf):
    m = _metrics(spark, sf).withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    return _rounded(evaluation.means(m, "category"), *_FIVE)


def e03_percentiles(spark, sf):
    return evaluation.nearest_rank(read(spark, sf, "lineitem"), "l_extendedprice", (0.5, 0.95, 0.99), "l_returnflag")


def e04_rank_pick(spark, sf):
    return evaluation.rank_pick(read(spark, sf, "lineitem"), "l_extendedprice", 0.95, "l_returnflag")


def e05_first_per_group(spark, sf):
    return evaluation.first_per_group(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("source", "doc_id", F.col("at").alias("pos"))


def e06_bootstrap(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    low, high = evaluation.bootstrap_interval(rows, "source", "quality") or (None, None)
    return spark.createDataFrame([(low, high)], "low double, high double")


def e07_exponential_ndcg(spark, sf):
    ranked = s11_batch_search(spark, sf).select("query_id", F.col("key").alias("doc_id"), "rank")
    return _rounded(evaluation.rank_metrics(ranked, _qrels(spark, sf), 10, exponential=True).select("query_id", "ndcg"), "ndcg")


def e08_rates(spark, sf):
    d = read(spark, sf, "documents").select((F.octet_length("text") > 16_384).alias("truncated"), (F.size(words(F.col("text"))) == 0).alias("failure"))
    return _rounded(evaluation.rates(d, "truncated", "failure"), "truncated_rate", "failure_rate")


def e09_context(spark, sf):
    hits = s11_batch_search(spark, sf).join(memories(spark, sf).select("key", "content", "tags"), "key")
    rows = hits.select("query_id", "rank", F.col("tags")[0].alias("source_id"), F.lit(0).alias("part"), "content")
    return evaluation.context_blocks(rows, 500, 3).select("query_id", "rank", "source_id", "words", "used", "words_kept")


def e10_ranking_figures(spark, sf):
    ranked = s11_batch_search(spark, sf).select("query_id", F.col("key").alias("doc_id"), "rank")
    queries_ = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return _rounded(evaluation.ranking_figures(ranked, _qrels(spark, sf), queries_), "recall_1", "recall_5", "recall_10", "ndcg", "mrr")


def e11_run_check(spark, sf):
    """Scores for an independent evaluator, and whether a hit is outside its query's scope (English)."""
    ranked = s11_batch_search(spark, sf).select("query_id", F.col("key").alias("doc_id"), "rank", F.lit("en").alias("scope"))
    docs = memories(spark, sf).select(F.col("key").alias("doc_id"), F.col("topic").alias("scope"))
    outside = evaluation.foreign_ranks(ranked, docs).select("query_id", "doc_id", F.lit(True).alias("outside"))
    run = evaluation.run_scores(ranked, 10).join(outside, ["query_id", "doc_id"], "left")
    return run.select("query_id", "doc_id", "run_score", F.coalesce("outside", F.lit(False)).alias("outside"))


def e12_answer_summary(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return _rounded(evaluation.answer_summary(rows, "source", "quality"), "qa_score")


def e13_answerable(spark, sf):
    """Queries with English positives, none of which is missing from the corpus without one source."""
    strong = _qrels(spark, sf).withColumn("gain", F.col("gain") - 1)
    queries_ = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    corpus = memories(spark, sf).where(~F.array_contains("tags", "src0")).select(F.col("key").alias("doc_id"))
    return evaluation.answerable(queries_, strong, corpus)


def d01_session_join(spark, sf):
    return readers.session_documents(read(spark, sf, "conversations"), "conv_id", "turn")


def d05_dated_sessions(spark, sf):
    """Sessions under their date; every third has none."""
    day = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("8 May, 20"), (F.col("conv_id") % 80 + 10).cast("string")))
    return readers.session_documents(read(spark, sf, "conversations").withColumn("day", day), "conv_id", "turn", "day")


def x04_metadata(spark, sf):
    """Fields of the records' metadata; broken texts have none."""
    e = read(spark, sf, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    return e.select("event_id", scalar.json_field(text, "k").alias("k"), scalar.json_field(text, "none").alias("none"))


def l09_profile_page_two(spark, sf):
    """The page behind the profile's first five facts."""
    slots = sinks.kept(lifecycle.fold_slots(proposals(spark, sf)), "slots")
    last = lifecycle.profile(slots, NOW_MS, 5).collect()[-1]
    page = lifecycle.profile(slots, NOW_MS, 5, (last["last_confirmed_at_ms"], last["entity"], last["attribute"]))
    return page.select("entity", "attribute", "last_confirmed_at_ms")


def d02_chunks(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.explode(fixed_chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.part").cast("long").alias("part"), F.md5("c.content").alias("md5"))


def d03_coverage(spark, sf):
    """A saved run that lacks some documents and changed others, against its source."""
    source = read(spark, sf, "documents").select("doc_id", "lang", "source")
    saved = source.where("doc_id % 7 != 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    return evaluation.uncovered(saved, source, ["doc_id"], ["lang", "source"]).select("doc_id", F.col("a").isNull().alias("missing"))


def d04_quoted_turns(spark, sf):
    c = read(spark, sf, "conversations")
    quote = F.substring("text", 3, 12)
    return c.select("conv_id", "turn", admission.quoted(F.col("text"), F.when(F.col("turn") % 2 == 0, quote).otherwise(F.concat(quote, F.lit("#")))).alias("quoted"))


def _daily(spark, sf):
    e = read(spark, sf, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def _snapshots(spark, sf):
    """Counters by day: what a user did up to then, seen on days with an event of that user."""
    e = read(spark, sf, "events")
    daily = e.groupBy(F.dayofmonth("ts").cast("long").alias("snapshot_id"), F.col("user_id").alias("asset")).agg(F.count("*").alias("count"))
    return daily


def g01_snapshot_delta(spark, sf):
    return ledger.snapshot_deltas(_snapshots(spark, sf))


def g02_trailing_days(spark, sf):
    return ledger.trailing_days(_daily(spark, sf), "event_type", "day", "n").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def g03_removed(spark, sf):
    return ledger.removed_assets(_snapshots(spark, sf), 10, 11)


def _units(spark, sf, events=None):
    e = read(spark, sf, "events") if events is None else events
    return e.select(F.col("event_type").alias("account"), F.col("event_id").alias("seq"), (millis("ts") / 1000.0).alias("at"), (F.col("event_id") % 100 * 300).alias("units"))


def g04_rate_window(spark, sf):
    return ledger.trailing(_units(spark, sf), 3600).select("account", "seq", "n", "total")


def g05_status_totals(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("status"), F.floor("value").cast("long").alias("charged"), F.ceil("value").cast("long").alias("reserved"))
    return ledger.status_totals(e)


def g06_admission(spark, sf):
    return ledger.admit(_units(spark, sf), 3600, 30, 150_000)


def g07_budget(spark, sf):
    e = read(spark, sf, "events")
    op = F.when(F.col("event_type").isin("click", "view"), "reserve").when(F.col("event_type") == "error", "unbilled").otherwise("settle")
    ops = e.select(F.concat(F.lit("a"), (F.col("user_id") % 3).cast("string")).alias("account"), F.col("event_id").alias("seq"), (F.col("user_id") % 40).cast("string").alias("id"), op.alias("op"), F.col("value").alias("amount"))
    return ledger.budget_ledger(ops, 400.0)


def g08_call_cost(spark, sf):
    e = read(spark, sf, "events")
    n = F.col("event_id") * 100
    cost = scalar.call_cost(n, (F.col("event_id") % 50).cast("long"), (F.col("event_id") % 1000).cast("long"))
    return e.select("event_id", F.round(cost, 12).alias("cost"))


def g09_resources(spark, sf):
    e = read(spark, sf, "events").select("event_type", "value", F.octet_length("props").cast("long").alias("size"), F.col("event_id").alias("n"), (F.col("user_id") + 1).alias("s"))
    return ledger.resource_summary(e, "event_type", "value", "size", "n", "s").withColumn("rate", F.round("rate", 9))


def g10_request_counters(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"))
    return ledger.request_counters(e, "user_id")


def k11_visible_at(spark, sf):
    return records.visible_at(event_log(spark, sf), NOW_MS - 5 * DAY_MS).select("namespace", "key", "revision")


def k12_record_errors(spark, sf):
    """Admission of raw records, with broken ones among them."""
    e = event_log(spark, sf)
    n = F.col("revision")
    key = F.when(n % 31 == 0, F.concat(F.lit("__"), "key")).when(n % 37 == 0, F.lit("")).otherwise(F.col("key"))
    value = F.when(n % 41 == 0, F.lit("{broken").cast("binary")).otherwise(F.col("value"))
    return e.select(admission.record_error(key, value, "json", 64, 4096).alias("error_code")).groupBy("error_code").agg(F.count("*").alias("n"))


def x01_scalars(spark, sf):
    e = read(spark, sf, "events")
    n = F.col("event_id")
    text = F.concat(F.lit("<think>no</think> well "), F.when(n % 3 == 0, "Yes!").when(n % 3 == 1, "yes or No").otherwise("maybe"))
    name = F.concat("event_type", F.lit(" /"), n.cast("string"))
    return e.select(
        "event_id",
        scalar.yes_no(text).alias("verdict"),
        scalar.percent_encoded(name).alias("path"),
        scalar.valid_id(F.when(n % 2 == 0, F.col("event_type")).otherwise(name)).alias("valid_id"),
        scalar.deadline(n, F.when(n % 5 == 0, F.lit((1 << 63) - 1)).otherwise(n)).alias("deadline_ms"),
        scalar.session_millis(F.concat(F.lit("1:56 pm on "), (n % 28 + 1).cast("string"), F.lit(" May, 2023"))).alias("session_ms"),
        scalar.natural_key(F.concat(F.lit("turn-"), n.cast("string")))["col2"].alias("natural"),
        scalar.content_type(F.when(n % 2 == 0, "json").otherwise("bytes")).alias("content_type"),
        F.sha2(F.col("props"), 256).alias("digest"),
    )


def x03_formats(spark, sf):
    """Keyword queries, values as shown text, and scores of judges' answers."""
    n = F.col("doc_id")
    value = F.when(n % 2 == 0, F.concat(F.lit("plain "), n.cast("string")).cast("binary")).when(n % 3 == 0, F.unhex(F.lit("ff00"))).otherwise(F.unhex(F.lit("fffe")))
    answer = F.when(n % 4 == 0, F.lit('```json\n{"score": 0.5}\n```')).when(n % 4 == 1, F.lit(' {"score": 1, "why": "x"}')).when(n % 4 == 2, F.lit('{"score": 0.7}')).otherwise(F.lit("none"))
    d = read(spark, sf, "documents")
    return d.select("doc_id", keyword_query(F.col("text")).alias("keywords"), scalar.display_bytes(value).alias("shown"), scalar.rubric_score(answer).alias("score"))


def k13_undeclared(spark, sf):
    """Namespaces of the log that a policy lacks (n3) or has in another mode (n0)."""
    held = event_log(spark, sf).select("namespace").distinct().withColumns({"mode": F.lit("durable"), "purpose": F.lit("records")})
    declared = spark.createDataFrame([("n0", "memory", "records"), ("n1", "durable", "records"), ("n2", "durable", "records")], "namespace string, mode string, purpose string")
    return records.undeclared(held, declared).select("namespace")


def x02_releases(spark, sf):
    e = read(spark, sf, "events")
    name = F.concat(F.lit("tool-v1."), (F.col("event_id") % 9).cast("string"), F.lit(".0-"), "event_type", F.when(F.col("event_id") % 2 == 0, ".tar.gz").otherwise(".txt"))
    return ledger.release_assets(e.select(name.alias("name"))).groupBy("version", "platform").agg(F.count("*").alias("n"))


def _stream(spark, sf, name):
    """A table as a stream; the pattern names a file and a folder alike."""
    schema = read(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


def _drained(spark, stream, mode, name):
    """All that a stream gives, written batch by batch and read back."""
    out, marks = sinks.shared_path(spark, name), sinks.shared_path(spark, f"{name}-marks")

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch_id={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*stream.columns)


def st01_stream_windows(spark, sf):
    """Counts by day and type over the events as a stream (beyond what the batch folds need)."""
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = folds.expiring_counts(events, "ts", "1 day", "1 hour", "event_type")
    flat = counted.select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
    return _drained(spark, flat, "complete", "windows")


def st02_stream_lifecycle(spark, sf):
    """The slots' receipts over proposals as a stream: the same as the batch fold's."""
    own = proposals(spark, sf, _stream(spark, sf, "events"))
    return _drained(spark, folds.lifecycle_stream(own), "append", "receipts").select("entity", "attribute", "seq", "status")


def st03_stream_pointers(spark, sf):
    """Newest checkpoint of each session over receipts as a stream."""
    c = _stream(spark, sf, "conversations").where("role = 'assistant'")
    name = lambda p: F.concat(F.lit(p), F.col("conv_id").cast("string"))
    receipts = c.select(
        name("c").alias("namespace"), F.lit("agent").alias("agent_id"), name("s").alias("session_id"), F.concat(name("c"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("error_code"), F.lit(True).alias("is_latest"), F.col("turn").cast("long").alias("latest_revision"),
    )
    return _drained(spark, folds.latest_pointers(receipts), "complete", "pointers").select("namespace", "session_id", "id", "latest_revision")


def st04_stream_cleanup(spark, sf):
    """What a scheduled cleanup keeps of each batch, written once a batch id."""
    out, marks = sinks.shared_path(spark, "kept"), sinks.shared_path(spark, "kept-marks")
    kept = folds.drop_expired(event_log(spark, sf, _stream(spark, sf, "events")), NOW_MS).select("namespace", "key", "revision")
    folds.write_once(kept, out, marks).awaitTermination()
    return spark.read.parquet(out).select("namespace", "key", "revision")


def st05_stream_admission(spark, sf):
    """Sliding admission over events as a stream: the same as the batch fold's."""
    units = _units(spark, sf, _stream(spark, sf, "events"))
    return _drained(spark, folds.admission_stream(units, 3600, 30, 150_000), "append", "admitted").select("account", "seq", "admitted")


_SQL_FIVE = """SELECT i.query_id, coalesce(found, 0) / positives AS recall, coalesce(dcg / idcg, 0e0) AS ndcg, coalesce(1e0 / first, 0e0) AS mrr,
 CASE WHEN coalesce(found, 0) > 0 THEN 1e0 ELSE 0e0 END AS any_evidence, CASE WHEN coalesce(found, 0) = positives THEN 1e0 ELSE 0e0 END AS all_evidence
 FROM i LEFT JOIN got USING (query_id)"""


def _sql_batch() -> str:
    return f"""{_POST}, a AS (SELECT item_id AS query_id, unnest({_sql_words("text")}) AS term FROM benchmark), qa AS (SELECT query_id, term, count(*) AS n FROM a GROUP BY ALL),
 nw AS (SELECT query_id, count(*) AS n_words FROM qa GROUP BY ALL), tdf AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM qa) GROUP BY term),
 wt AS (SELECT query_id, term, ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * CASE WHEN n_words > 64 THEN sqrt(n::DOUBLE) ELSE 1e0 END AS weight FROM qa JOIN tdf USING (term) JOIN nw USING (query_id), st),
 pl AS (SELECT * FROM wt QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) <= 64),
 sc AS (SELECT query_id, key, round(sum(weight * (tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * doc_len / (tokens::DOUBLE / docs))))), 9) AS score FROM p JOIN pl USING (term), st GROUP BY ALL),
 rk AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM sc QUALIFY rank <= 10)"""


def _sql_metrics(gain: str = "gain::DOUBLE") -> str:
    return f"""{_sql_batch()}, {_QRELS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS pos FROM qr),
 i AS (SELECT query_id, count(*) AS positives, sum(CASE WHEN pos <= 10 THEN ({gain}) / log2(pos + 1e0) END) AS idcg FROM o GROUP BY 1),
 got AS (SELECT rk.query_id, count(*) AS found, sum(({gain}) / log2(rank + 1e0)) AS dcg, min(rank) AS first FROM rk JOIN qr ON rk.query_id = qr.query_id AND rk.key = qr.doc_id GROUP BY 1)"""


def _page(where: str, limit: int = 20) -> str:
    return f"WITH {_MEM} SELECT key, topic, occurred_at_ms FROM m WHERE {where} ORDER BY occurred_at_ms DESC, key DESC LIMIT {limit}"


_ROUND_FIVE = ", ".join(f"round({c}, 9) AS {c}" for c in _FIVE)
_PROPOSALS = f"""pr AS (SELECT 'user ' || user_id AS entity, event_type AS attribute, event_id AS seq, CASE WHEN value > 20 THEN 'high' ELSE 'low' END AS value,
 epoch_us(ts) // 1000 - CASE WHEN event_id % 11 = 0 THEN {3 * DAY_MS} ELSE 0 END AS ms FROM events)"""

#: A slot's proposals one after another: its value, last confirmation, and how many receipts, stale
#: events and conflicts it holds. (The state's byte limit is not reached by the events' short texts.)
_SQL_SLOTS = f"""WITH RECURSIVE {_PROPOSALS}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY seq) AS i FROM pr),
 f AS (SELECT entity, attribute, seq, i, 'created' AS status, value, ms AS confirmed, 1::BIGINT AS taken, 0::BIGINT AS stale, 0::BIGINT AS conflict, 'active' AS state FROM n WHERE i = 1
 UNION ALL SELECT entity, attribute, seq, i, CASE WHEN full_ THEN 'capacity' ELSE st END, value, CASE WHEN NOT full_ AND st = 'duplicate' THEN ms ELSE confirmed END, taken + (NOT full_)::BIGINT,
 stale + (NOT full_ AND st = 'stale')::BIGINT, conflict + (NOT full_ AND st = 'conflict')::BIGINT, CASE WHEN conflict > 0 OR (NOT full_ AND st = 'conflict') THEN 'conflicted' ELSE 'active' END FROM
 (SELECT *, s2 > 8 OR taken + 1 + (c2 > 0)::BIGINT > 24 OR (c2 > 0 AND s2 + 1 + c2 > 8) AS full_ FROM (SELECT *, stale + (st = 'stale')::BIGINT AS s2, conflict + (st = 'conflict')::BIGINT AS c2 FROM
 (SELECT n.entity, n.attribute, n.seq, n.i, n.ms, f.value, f.confirmed, f.taken, f.stale, f.conflict, CASE WHEN n.ms < f.confirmed THEN 'stale' WHEN n.value = f.value THEN 'duplicate' ELSE 'conflict' END AS st
 FROM f JOIN n ON n.entity = f.entity AND n.attribute = f.attribute AND n.i = f.i + 1))))"""
_SLOT_ROWS = """z AS (SELECT 'personal' AS scope, entity, attribute, state, value, 'fact' AS kind, NULL::BIGINT AS valid_until_ms, confirmed AS last_confirmed_at_ms, taken AS revision, stale AS history, conflict AS conflicts,
 taken AS receipts, CASE WHEN state = 'active' THEN entity || ' / ' || attribute || ': ' || value ELSE 'Unresolved memory.' END AS content FROM f QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY i DESC) = 1)"""
_SQL_ADMISSION = """WITH RECURSIVE u AS MATERIALIZED (SELECT event_type AS account, event_id AS seq, (epoch_us(ts) // 1000) / 1000e0 AS ms, event_id % 100 * 300 AS units, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
 f AS (SELECT account, seq, ms, units, i, [{'ms': ms, 'units': units}] AS held, true AS admitted FROM u WHERE i = 1
 UNION ALL SELECT account, seq, ms, units, i, CASE WHEN ok THEN list_append(kept, {'ms': ms, 'units': units}) ELSE kept END, ok FROM
 (SELECT *, len(kept) < 30 AND coalesce(list_sum(list_transform(kept, lambda x: x.units)), 0) + units <= 150000 AS ok FROM
 (SELECT u.account, u.seq, u.ms, u.units, u.i, list_filter(f.held, lambda x: x.ms >= u.ms - 3600) AS kept FROM f JOIN u ON u.account = f.account AND u.i = f.i + 1)))
 SELECT account, seq, ms AS "at", units, admitted FROM f"""
_SQL_BUDGET = """WITH RECURSIVE o AS MATERIALIZED (SELECT 'a' || (user_id % 3) AS account, event_id AS seq, (user_id % 40)::VARCHAR AS id, CASE WHEN event_type IN ('click', 'view') THEN 'reserve' WHEN event_type = 'error' THEN 'unbilled' ELSE 'settle' END AS op,
 value AS amount, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS i FROM events),
 f AS (SELECT account, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS id, NULL::BOOLEAN AS admitted, 0e0 AS accounted, []::STRUCT(id VARCHAR, amount DOUBLE)[] AS held FROM (SELECT DISTINCT account FROM o)
 UNION ALL SELECT account, i, seq, id, ok, CASE WHEN NOT ok THEN accounted WHEN op = 'reserve' THEN accounted + amount ELSE accounted + (price - own.amount) END,
 CASE WHEN NOT ok THEN held WHEN op = 'reserve' THEN list_append(held, {'id': id, 'amount': amount}) ELSE list_filter(held, lambda x: x.id <> id) END FROM
 (SELECT *, CASE WHEN op = 'reserve' THEN own IS NULL AND accounted + amount <= 400 ELSE own IS NOT NULL AND price <= own.amount + 1e-12 END AS ok FROM
 (SELECT o.account, o.i, o.seq, o.id, o.op, o.amount, f.accounted, f.held, list_filter(f.held, lambda x: x.id = o.id)[1] AS own, CASE WHEN o.op = 'settle' THEN o.amount ELSE 0e0 END AS price
 FROM f JOIN o ON o.account = f.account AND o.i = f.i + 1)))
 SELECT account, seq, id, admitted, accounted FROM f WHERE i > 0"""
#: A namespace's operations one after another over the list of its records.
_SQL_FOLD = """WITH RECURSIVE o AS MATERIALIZED (SELECT 'n' || (user_id % 4) AS namespace, event_id AS seq, 'user/' || user_id AS key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'cleanup' ELSE 'put' END AS op,
 strlen('user/' || user_id) + strlen(props) AS size, CASE event_type WHEN 'click' THEN 'absent' WHEN 'purchase' THEN (event_id % 7 + 1)::VARCHAR END AS cond, epoch_us(ts) // 1000 AS now,
 CASE event_type WHEN 'view' THEN epoch_us(ts) // 1000 + 86400000 END AS expires, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS i FROM events),
 f AS (SELECT namespace, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS key, NULL::VARCHAR AS op, NULL::VARCHAR AS error_code, NULL::BIGINT AS revision, 0::BIGINT AS high,
 []::STRUCT(key VARCHAR, revision BIGINT, expires BIGINT, size BIGINT)[] AS held FROM (SELECT DISTINCT namespace FROM o)
 UNION ALL SELECT namespace, i, seq, key, op, error, CASE WHEN error IS NOT NULL THEN NULL WHEN op = 'put' THEN high + 1 WHEN op = 'delete' THEN own.revision ELSE len(gone) END,
 high + (op = 'put' AND error IS NULL)::BIGINT, CASE WHEN error IS NOT NULL THEN held WHEN op = 'put' THEN list_append(list_filter(held, lambda x: x.key <> key), {'key': key, 'revision': high + 1, 'expires': expires, 'size': size})
 WHEN op = 'delete' THEN list_filter(held, lambda x: x.key <> key) ELSE list_filter(held, lambda x: NOT list_contains(gone, x.revision)) END FROM
 (SELECT *, CASE WHEN op = 'cleanup' THEN NULL WHEN op = 'delete' THEN CASE WHEN live THEN NULL ELSE 'not_found' END
 WHEN NOT (cond IS NULL OR (cond = 'absent' AND NOT live) OR (cond <> 'absent' AND live AND own.revision::VARCHAR = cond)) THEN 'conflict'
 WHEN len(held) + (own IS NULL)::BIGINT > 30 OR coalesce(list_sum(list_transform(held, lambda x: x.size)), 0) - coalesce(own.size, 0) + size > 1048576 THEN 'quota' END AS error FROM
 (SELECT *, own IS NOT NULL AND coalesce(own.expires > now, true) AS live, list_transform(list_sort(list_transform(list_filter(held, lambda x: x.expires <= now), lambda x: {'a': x.expires, 'b': x.revision}))[1:5], lambda y: y.b) AS gone FROM
 (SELECT o.namespace, o.i, o.seq, o.key, o.op, o.size, o.cond, o.now, o.expires, f.high, f.held, list_filter(f.held, lambda x: x.key = o.key)[1] AS own FROM f JOIN o ON o.namespace = f.namespace AND o.i = f.i + 1))))
 SELECT namespace, seq, key, op, error_code, revision, '' AS evicted, len(held) AS entries, coalesce(list_sum(list_transform(held, lambda x: x.size)), 0)::BIGINT AS bytes FROM f WHERE i > 0"""

CATALOGUE: dict[str, tuple[Callable, str | None]] = {
    "s01_tokens_per_doc": (s01_tokens_per_doc, f"WITH {_TOKENS} SELECT key, len(words) AS doc_len FROM d"),
    "s02_term_df": (s02_term_df, f"WITH {_POST} SELECT term, count(*) AS df FROM p GROUP BY term"),
    "s03_corpus_stats": (s03_corpus_stats, f"WITH {_POST} SELECT docs, tokens::BIGINT AS tokens, tokens::DOUBLE / docs AS mean_len FROM st"),
    "s04_bm25_top20": (partial(_hits, SearchQuery(QUERY, stemmed=False)), f"WITH {_sql_scores(TERMS)} SELECT key, score FROM s ORDER BY score DESC, key LIMIT 20"),
    "s05_bm25_all": (s05_bm25_all, f"WITH {_sql_scores(TERMS)} SELECT key, score FROM s"),
    "s06_bm25_filtered": (
        partial(_hits, SearchQuery(QUERY, Filters("EN ", None, BASE_MS + 50, BASE_MS + 600), stemmed=False)),
        f"WITH {_sql_scores(TERMS)} SELECT s.key, score FROM s JOIN m USING (key) WHERE topic = 'en' AND occurred_at_ms BETWEEN {BASE_MS + 50} AND {BASE_MS + 600} ORDER BY score DESC, key LIMIT 20",
    ),
    "s07_bm25_stemmed": (partial(_hits, SearchQuery("tioned heating")), f"WITH {_sql_scores({'tion': 1.0, 'heat': 1.0}, _CASE)} SELECT key, score FROM s ORDER BY score DESC, key LIMIT 20"),
    "s08_bm25_expanded": (
        partial(_hits, SearchQuery("tion", expansion_terms=("heat", "thing"), stemmed=False)),
        f"WITH {_sql_scores({'tion': 1.0, 'heat': 0.25, 'thing': 0.25})} SELECT key, score FROM s ORDER BY score DESC, key LIMIT 20",
    ),
    "s09_long_query": (
        s09_long_query,
        f"""WITH {_POST}, a AS (SELECT unnest({_sql_words("text")}) AS term FROM benchmark WHERE item_id < 5), qa AS (SELECT term, count(*) AS n FROM a GROUP BY term),
 tdf AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM qa) GROUP BY term),
 pl AS (SELECT term, ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) * CASE WHEN (SELECT count(*) FROM qa) > 64 THEN sqrt(n::DOUBLE) ELSE 1e0 END AS weight FROM qa JOIN tdf USING (term), st ORDER BY weight DESC, term LIMIT 64)
 SELECT key, round(sum(weight * (tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * doc_len / (tokens::DOUBLE / docs))))), 9) AS score FROM p JOIN pl USING (term), st GROUP BY key ORDER BY score DESC, key LIMIT 20""",
    ),
    "s10_page_two": (s10_page_two, f"WITH {_sql_scores(TERMS)} SELECT key, score FROM s ORDER BY score DESC, key LIMIT 10 OFFSET 10"),
    "s11_batch_search": (s11_batch_search, f"WITH {_sql_batch()} SELECT query_id, key, score, rank FROM rk"),
    "s12_counters": (
        s12_counters,
        f"""WITH {_POST}, o AS (SELECT * FROM p WHERE term IN ('tion', 'heat', 'thing')) SELECT 3::BIGINT AS query_terms, count(DISTINCT term) AS selected_terms,
 count(*) AS postings_scanned, count(*) + count(DISTINCT term) AS index_reads, false AS truncated, count(DISTINCT key) AS scored_candidates FROM o""",
    ),
    "r01_recall_topic": (_recall(Filters(topic=" FR")), _page("topic = 'fr'")),
    "r02_recall_tag_time": (_recall(Filters(tag="src3", from_ms=BASE_MS + 10, to_ms=BASE_MS + 700)), _page(f"tag = 'src3' AND occurred_at_ms BETWEEN {BASE_MS + 10} AND {BASE_MS + 700}")),
    "r03_recall_literal": (_recall(Filters(), "The Heat"), _page("contains(lower(content), 'the') AND contains(lower(content), 'heat')")),
    "r04_recall_page_two": (_recall(Filters(topic="en"), "", (BASE_MS + 500, "doc/500"), 30), _page(f"topic = 'en' AND (occurred_at_ms < {BASE_MS + 500} OR (occurred_at_ms = {BASE_MS + 500} AND key < 'doc/500'))", 30)),
    "r05_recall_bytes": (
        r05_recall_bytes,
        f"""WITH {_MEM}, t AS (SELECT key, occurred_at_ms, strlen(content) AS size FROM m WHERE topic = 'en' ORDER BY occurred_at_ms DESC, key DESC LIMIT 100)
 SELECT key, occurred_at_ms, used FROM (SELECT key, occurred_at_ms, sum(size) OVER (ORDER BY occurred_at_ms DESC, key DESC)::BIGINT AS used FROM t) WHERE used <= 16384""",
    ),
    "r06_recall_bounded": (
        r06_recall_bounded,
        f"""WITH {_MEM}, t AS (SELECT * FROM m WHERE topic = 'en' ORDER BY occurred_at_ms DESC, key DESC LIMIT 150), z AS (SELECT key FROM t ORDER BY occurred_at_ms, key LIMIT 1)
 SELECT t.key, t.occurred_at_ms, (SELECT key FROM z) AS last_key FROM t WHERE contains(lower(content), 'heat')""",
    ),
    "r07_recall_topic_tag": (_recall(Filters(topic="en", tag="SRC1 ")), _page("topic = 'en' AND tag = 'src1'")),
    "s13_index_update": (
        s13_index_update,
        f"""WITH mm AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Fresh words of ' || lang ELSE text END AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 <> 0),
 x AS (SELECT doc_id, unnest({_sql_words("text")}) AS term FROM mm) SELECT term, count(DISTINCT doc_id) AS df FROM x GROUP BY term""",
    ),
    "m01_admission": (m01_admission, f"WITH {_MEM} SELECT key, CASE WHEN strlen(content) NOT BETWEEN 1 AND 16384 THEN 'invalid_content' END AS error_code FROM m"),
    "m02_index_entries": (
        m02_index_entries,
        f"""WITH {_MEM}, e AS (SELECT 'time' AS kind, '' AS label, occurred_at_ms FROM m UNION ALL SELECT 'topic', topic, occurred_at_ms FROM m UNION ALL SELECT 'tag', tag, occurred_at_ms FROM m)
 SELECT kind, label, count(*) AS n, max(occurred_at_ms) AS newest_ms FROM e GROUP BY ALL""",
    ),
    "m03_labels": (m03_labels, "SELECT doc_id, CASE WHEN lang < source THEN lang || ',' || source ELSE source || ',' || lang END AS tags, lang AS topic FROM documents"),
    "k01_list_prefix": (
        k01_list_prefix,
        f"WITH {_LATEST} SELECT key, revision, strlen(value) AS bytes, expires_at_ms FROM r WHERE namespace = 'n1' AND starts_with(key, 'user/1') AND key > 'user/101' AND coalesce(expires_at_ms > {NOW_MS}, true) ORDER BY key LIMIT 50",
    ),
    "k02_get_live": (k02_get_live, f"WITH {_LATEST} SELECT namespace, key, revision, expires_at_ms FROM r WHERE namespace = 'n1' AND key = 'user/5' AND coalesce(expires_at_ms > {NOW_MS}, true)"),
    "k03_live_at": (k03_live_at, f"WITH {_LATEST} SELECT namespace, count(*) AS n, max(revision) AS revision FROM r WHERE coalesce(expires_at_ms > {NOW_MS}, true) GROUP BY namespace"),
    "k04_latest_per_key": (k04_latest_per_key, f"WITH {_LATEST} SELECT namespace, key, revision, event_type FROM r"),
    "k05_usage": (k05_usage, f"WITH {_LATEST} SELECT namespace, count(*) AS entries, sum(strlen(key) + strlen(value))::BIGINT AS bytes FROM r GROUP BY namespace"),
    "k06_expired_batch": (k06_expired_batch, f"WITH {_LATEST} SELECT namespace, key, expires_at_ms, revision FROM r WHERE expires_at_ms <= {LATER_MS} ORDER BY expires_at_ms, revision, namespace, key LIMIT 25"),
    "k07_fifo_kept": (
        k07_fifo_kept,
        f"""WITH {_LATEST}, n AS (SELECT namespace, key, inserted, count(*) OVER w AS n, sum(strlen(key) + strlen(value)) OVER w AS used FROM r
 WINDOW w AS (PARTITION BY namespace ORDER BY inserted DESC ROWS UNBOUNDED PRECEDING)) SELECT namespace, key, inserted FROM n WHERE n <= 20 AND used <= 170""",
    ),
    "k08_put_fold": (k08_put_fold, _SQL_FOLD),
    "k09_puts_and_deletes": (
        k09_puts_and_deletes,
        """WITH o AS (SELECT 'n' || (user_id % 4) AS namespace, 'user/' || user_id AS key, props AS value, event_type, event_id FROM events WHERE event_type <> 'signup'),
 n AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY namespace ORDER BY event_id) AS revision FROM o),
 z AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY event_id DESC) = 1)
 SELECT namespace, key, value, revision FROM z WHERE event_type <> 'error'""",
    ),
    "k10_grants": (k10_grants, f"WITH {_LATEST} SELECT namespace, count(*) AS n FROM r WHERE namespace IN ('n1', 'n2') GROUP BY namespace"),
    "c01_latest_checkpoint": (
        c01_latest_checkpoint,
        """WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations WHERE role = 'assistant' AND trim(text) <> '')
 SELECT 's' || conv_id AS session_id, 'c' || conv_id || '-' || turn AS id, 2 * n - 1 AS revision, 2 * n AS latest_revision FROM a WHERE z = 1""",
    ),
    "c03_prunable": (
        c03_prunable,
        """SELECT 'c' || conv_id AS namespace, 'c' || conv_id || '-' || turn AS id FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations WHERE role = 'assistant' AND trim(text) <> '') WHERE z > 1""",
    ),
    "c02_reference_status": (
        c02_reference_status,
        f"""WITH {_LATEST}, f AS (SELECT namespace, CASE WHEN revision % 50 = 0 THEN key || '-gone' ELSE key END AS key, revision FROM l),
 v AS (SELECT namespace, key, revision AS c FROM r WHERE coalesce(expires_at_ms > {NOW_MS}, true))
 SELECT f.namespace, f.key, f.revision, CASE WHEN f.namespace = 'n3' THEN 'forbidden' WHEN c IS NULL THEN 'missing' WHEN c = f.revision THEN 'available' ELSE 'stale' END AS status FROM f LEFT JOIN v ON f.namespace = v.namespace AND f.key = v.key""",
    ),
    "l01_receipts": (l01_receipts, f"{_SQL_SLOTS} SELECT 'personal' AS scope, entity, attribute, seq, status, false AS replayed, taken AS revision, state FROM f"),
    "l02_profile": (l02_profile, f"{_SQL_SLOTS}, {_SLOT_ROWS} SELECT * FROM z WHERE state = 'active' ORDER BY last_confirmed_at_ms DESC, entity DESC, attribute DESC LIMIT 100"),
    "l03_slots": (l03_slots, f"{_SQL_SLOTS}, {_SLOT_ROWS} SELECT * FROM z"),
    "l06_profile_bytes": (
        l06_profile_bytes,
        f"""{_SQL_SLOTS}, {_SLOT_ROWS}, t AS (SELECT * FROM z WHERE state = 'active' ORDER BY last_confirmed_at_ms DESC, entity DESC, attribute DESC LIMIT 100),
 j AS (SELECT *, strlen('{{"entity":"' || entity || '","attribute":"' || attribute || '","value":"' || value || '","revision":' || revision || '}}') + 1 AS size FROM t),
 w AS (SELECT *, 29 + sum(size) OVER (ORDER BY last_confirmed_at_ms DESC, entity DESC, attribute DESC)::BIGINT AS used FROM j)
 SELECT entity, attribute, value, revision, used, (SELECT max(used) FROM w) > 2048 AS truncated FROM w WHERE used <= 2048""",
    ),
    "l07_slot_keys": (l07_slot_keys, f"""WITH {_PROPOSALS} SELECT seq, 'mc/' || sha256('["personal","' || entity || '","' || attribute || '"]') AS slot_key FROM pr"""),
    "l08_context": (
        l08_context,
        f"""{_SQL_SLOTS}, {_SLOT_ROWS}, d AS (SELECT *, {_sql_words("content")} AS words FROM z), x AS (SELECT entity, attribute, len(words) AS doc_len, unnest(words) AS term FROM d),
 st AS (SELECT count(*) AS docs, sum(len(words)) AS tokens FROM d), p AS (SELECT entity, attribute, doc_len, term, count(*) AS tf FROM x WHERE term IN ('high', 'purchase', 'user') GROUP BY ALL),
 t AS (SELECT term, ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
 s AS (SELECT entity, attribute, round(sum(weight * (tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * doc_len / (tokens::DOUBLE / docs))))), 9) AS score FROM p JOIN t USING (term), st GROUP BY ALL)
 SELECT entity, attribute, score FROM s JOIN z USING (entity, attribute) WHERE state = 'active' ORDER BY score DESC, entity, attribute LIMIT 100""",
    ),
    "l10_inspect": (l10_inspect, f"{_SQL_SLOTS}, {_SLOT_ROWS} SELECT entity, attribute, state, value, revision FROM z WHERE entity = 'user 5' AND attribute = 'click'"),
    "l05_proposal_errors": (
        l05_proposal_errors,
        """SELECT CASE WHEN event_id % 17 <> 0 AND event_id % 19 = 0 THEN 'invalid_operation' WHEN event_id % 13 = 0 THEN 'invalid_role' WHEN event_id % 17 = 0 THEN 'missing_revision' END AS error_code, count(*) AS n
 FROM events GROUP BY ALL""",
    ),
    "e01_rank_metrics": (e01_rank_metrics, f"WITH {_sql_metrics()}, f AS ({_SQL_FIVE}) SELECT query_id, {_ROUND_FIVE} FROM f"),
    "e02_means": (
        e02_means,
        f"""WITH {_sql_metrics()}, f AS ({_SQL_FIVE}), c AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM f)
 SELECT category, count(*) AS queries, {", ".join(f"round(avg({c}), 9) AS {c}" for c in _FIVE)} FROM c GROUP BY ROLLUP (category)""",
    ),
    "e03_percentiles": (
        e03_percentiles,
        """SELECT l_returnflag, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice)::DOUBLE AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice)::DOUBLE AS p95,
 percentile_disc(0.99) WITHIN GROUP (ORDER BY l_extendedprice)::DOUBLE AS p99 FROM lineitem GROUP BY 1""",
    ),
    "e04_rank_pick": (
        e04_rank_pick,
        """SELECT l_returnflag, min(l_extendedprice)::DOUBLE AS value FROM (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
 WHERE i > ceil((n - 1) * 95e-2) GROUP BY 1""",
    ),
    "e05_first_per_group": (e05_first_per_group, "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents QUALIFY pos <= 2"),
    "e06_bootstrap": (e06_bootstrap, None),
    "e07_exponential_ndcg": (e07_exponential_ndcg, f"WITH {_sql_metrics('pow(2e0, gain) - 1e0')}, f AS ({_SQL_FIVE}) SELECT query_id, round(ndcg, 9) AS ndcg FROM f"),
    "e08_rates": (
        e08_rates,
        f"SELECT count(*) AS n, round(avg((strlen(text) > 16384)::INT), 9) AS truncated_rate, round(avg((len({_sql_words('text')}) = 0)::INT), 9) AS failure_rate FROM documents",
    ),
    "e09_context": (
        e09_context,
        f"""WITH {_sql_batch()}, h AS (SELECT query_id, rank, source AS source_id, chr(10) || '[Source ' || source || ', part 0]' || chr(10) || text AS text FROM rk JOIN documents ON key = 'doc/' || doc_id),
 fr AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source_id) AS first, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS words FROM h),
 so AS (SELECT * FROM fr QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY first) <= 3),
 us AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM so)
 SELECT query_id, rank, source_id, words, used, least(words, 500 - used) AS words_kept FROM us WHERE used < 500""",
    ),
    "e10_ranking_figures": (
        e10_ranking_figures,
        f"""WITH {_sql_metrics()}, c AS (SELECT query_id, count(*) FILTER (rank <= 1) AS f1, count(*) FILTER (rank <= 5) AS f5, count(*) FILTER (rank <= 10) AS f10 FROM rk JOIN qr ON rk.query_id = qr.query_id AND rk.key = qr.doc_id GROUP BY rk.query_id)
 SELECT q.item_id AS query_id, round(CASE WHEN positives IS NOT NULL THEN coalesce(f1 / positives, 0) END, 9) AS recall_1, round(CASE WHEN positives IS NOT NULL THEN coalesce(f5 / positives, 0) END, 9) AS recall_5,
 round(CASE WHEN positives IS NOT NULL THEN coalesce(f10 / positives, 0) END, 9) AS recall_10, round(CASE WHEN positives IS NOT NULL THEN coalesce(dcg / idcg, 0) END, 9) AS ndcg, round(CASE WHEN positives IS NOT NULL THEN coalesce(1e0 / first, 0) END, 9) AS mrr
 FROM benchmark q LEFT JOIN i ON q.item_id = i.query_id LEFT JOIN got ON q.item_id = got.query_id LEFT JOIN c ON q.item_id = c.query_id""".replace("FROM rk JOIN qr ON rk.query_id = qr.query_id AND rk.key = qr.doc_id GROUP BY rk.query_id", "FROM (SELECT rk.query_id, rank FROM rk JOIN qr ON rk.query_id = qr.query_id AND rk.key = qr.doc_id) GROUP BY query_id"),
    ),
    "e11_run_check": (
        e11_run_check,
        f"""WITH {_sql_batch()} SELECT query_id, key AS doc_id, 11 - rank AS run_score, lang <> 'en' AS outside FROM rk JOIN documents ON key = 'doc/' || doc_id""",
    ),
    "e12_answer_summary": (
        e12_answer_summary,
        "SELECT source, count(*) AS questions, round(avg(quality), 9) AS qa_score, count(*) FILTER (quality >= 1) AS correct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)",
    ),
    "e13_answerable": (
        e13_answerable,
        f"WITH {_QRELS}, p AS (SELECT query_id, doc_id FROM qr WHERE gain > 1) SELECT item_id AS query_id FROM benchmark WHERE item_id IN (SELECT query_id FROM p) AND item_id NOT IN (SELECT query_id FROM p JOIN documents ON p.doc_id = 'doc/' || documents.doc_id WHERE source = 'src0')",
    ),
    "d01_session_join": (d01_session_join, "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id"),
    "d05_dated_sessions": (
        d05_dated_sessions,
        "SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN '8 May, 20' || (conv_id % 80 + 10) || chr(10) ELSE '' END || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
    ),
    "x04_metadata": (x04_metadata, "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN json_extract_string(props, '$.k') END AS k, NULL::VARCHAR AS none FROM events"),
    "l09_profile_page_two": (
        l09_profile_page_two,
        f"{_SQL_SLOTS}, {_SLOT_ROWS} SELECT entity, attribute, last_confirmed_at_ms FROM z WHERE state = 'active' ORDER BY last_confirmed_at_ms DESC, entity DESC, attribute DESC LIMIT 5 OFFSET 5",
    ),
    "d02_chunks": (
        d02_chunks,
        """SELECT doc_id, s // 9500 AS part, md5(substring(text, s + 1, 9500)) AS md5 FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 9500)) AS s FROM documents)""",
    ),
    "d03_coverage": (d03_coverage, "SELECT doc_id, doc_id % 7 = 0 AS missing FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0"),
    "d04_quoted_turns": (
        d04_quoted_turns,
        "SELECT conv_id, turn, substring(text, 3, 12) || CASE WHEN turn % 2 = 0 THEN '' ELSE '#' END <> '' AND contains(text, substring(text, 3, 12) || CASE WHEN turn % 2 = 0 THEN '' ELSE '#' END) AS quoted FROM conversations",
    ),
    "g01_snapshot_delta": (
        g01_snapshot_delta,
        """WITH s AS (SELECT day(ts)::BIGINT AS snapshot_id, user_id AS asset, count(*) AS count FROM events GROUP BY ALL), i AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS b FROM (SELECT DISTINCT snapshot_id FROM s))
 SELECT s.snapshot_id, s.asset, s.count, s.count - o.count AS change, coalesce(s.count < o.count, false) AS decreased FROM s JOIN i USING (snapshot_id) LEFT JOIN s o ON o.snapshot_id = i.b AND o.asset = s.asset""",
    ),
    "g02_trailing_days": (
        g02_trailing_days,
        """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL)
 SELECT event_type, day, n, sum(n) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS last_7, coalesce(sum(n) OVER (w ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), 0)::BIGINT AS previous_7 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
    ),
    "g03_removed": (g03_removed, "SELECT user_id AS asset FROM events WHERE day(ts) = 10 EXCEPT SELECT user_id FROM events WHERE day(ts) = 11"),
    "g04_rate_window": (
        g04_rate_window,
        """SELECT event_type AS account, event_id AS seq, count(*) OVER w AS n, sum(event_id % 100 * 300) OVER w::BIGINT AS total FROM events
 WINDOW w AS (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) / 1000e0 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""",
    ),
    "g05_status_totals": (g05_status_totals, "SELECT event_type AS status, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS charged, sum(ceil(value)::BIGINT)::BIGINT AS reserved FROM events GROUP BY 1"),
    "g06_admission": (g06_admission, _SQL_ADMISSION),
    "g07_budget": (g07_budget, _SQL_BUDGET),
    "g09_resources": (
        g09_resources,
        "SELECT event_type, max(value) AS peak_memory, max(strlen(props)) AS peak_size, round(sum(event_id) / sum(user_id + 1)::DOUBLE, 9) AS rate FROM events GROUP BY 1",
    ),
    "g10_request_counters": (g10_request_counters, "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1"),
    "k11_visible_at": (
        k11_visible_at,
        f"""WITH {_LOG} SELECT namespace, key, revision FROM (SELECT * FROM l WHERE written_at_ms <= {NOW_MS - 5 * DAY_MS} QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY revision DESC) = 1)
 WHERE coalesce(expires_at_ms > {NOW_MS - 5 * DAY_MS}, true)""",
    ),
    "k12_record_errors": (
        k12_record_errors,
        """SELECT CASE WHEN (event_id + 1) % 31 = 0 OR (event_id + 1) % 37 = 0 THEN 'invalid_key' WHEN (event_id + 1) % 41 = 0 THEN 'invalid_value' END AS error_code, count(*) AS n FROM events GROUP BY 1""",
    ),
    "x01_scalars": (
        x01_scalars,
        """SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict, event_type || '%20%2F' || event_id AS path, event_id % 2 = 0 AS valid_id,
 CASE WHEN event_id % 5 <> 0 THEN event_id + event_id * 1000 END AS deadline_ms, epoch_ms(make_timestamp(2023, 5, event_id % 28 + 1, 13, 56, 0)) AS session_ms, event_id AS natural,
 CASE WHEN event_id % 2 = 0 THEN 'application/json' ELSE 'application/octet-stream' END AS content_type, sha256(props) AS digest FROM events""",
    ),
    "x03_formats": (
        x03_formats,
        f"""SELECT doc_id, left(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], w))[1:8], ' '), 256) AS keywords,
 CASE WHEN doc_id % 2 = 0 THEN 'plain ' || doc_id ELSE base64(unhex('ff' || CASE WHEN doc_id % 3 = 0 THEN '00' ELSE 'fe' END)) END AS shown, CASE doc_id % 4 WHEN 0 THEN 5e-1 WHEN 1 THEN 1e0 END AS score FROM documents""",
    ),
    "k13_undeclared": (k13_undeclared, "SELECT DISTINCT 'n' || (user_id % 4) AS namespace FROM events WHERE user_id % 4 IN (0, 3)"),
    "x02_releases": (x02_releases, "SELECT '1.' || event_id % 9 || '.0' AS version, event_type AS platform, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL"),
    "st01_stream_windows": (st01_stream_windows, "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL"),
    "st02_stream_lifecycle": (st02_stream_lifecycle, f"{_SQL_SLOTS} SELECT entity, attribute, seq, status FROM f"),
    "st03_stream_pointers": (
        st03_stream_pointers,
        """SELECT 'c' || conv_id AS namespace, 's' || conv_id AS session_id, 'c' || conv_id || '-' || max(turn) AS id, max(turn) AS latest_revision FROM conversations WHERE role = 'assistant' GROUP BY conv_id""",
    ),
    "st04_stream_cleanup": (st04_stream_cleanup, f"WITH {_LOG} SELECT namespace, key, revision FROM l WHERE coalesce(expires_at_ms > {NOW_MS}, true)"),
    "st05_stream_admission": (st05_stream_admission, f"SELECT account, seq, admitted FROM ({_SQL_ADMISSION})"),
    "g08_call_cost": (
        g08_call_cost,
        """SELECT event_id, round(((event_id * 100 - event_id % 50) * CASE WHEN event_id * 100 > 272000 THEN 25e-2 ELSE 125e-3 END + (event_id % 50) * CASE WHEN event_id * 100 > 272000 THEN 25e-3 ELSE 125e-4 END
 + (event_id % 1000) * CASE WHEN event_id * 100 > 272000 THEN 75e-2 ELSE 5e-1 END) / 1e6, 12) AS cost FROM events""",
    ),
}


CATALOGUE |= ROUND_TRIPS
_run, _ = CATALOGUE["en04_engine_search"]
CATALOGUE["en04_engine_search"] = (
    _run,
    f"""WITH d AS (SELECT 'item/' || item_id AS key, {_sql_words("text")} AS words FROM benchmark), x AS (SELECT key, len(words) AS doc_len, unnest(words) AS term FROM d), st AS (SELECT count(*) AS docs, sum(len(words)) AS tokens FROM d),
 p AS (SELECT key, doc_len, term, count(*) AS tf FROM x WHERE term IN ('tion', 'heat', 'thing') GROUP BY ALL), t AS (SELECT term, ln(1e0 + (docs - df + 5e-1) / (df + 5e-1)) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), st),
 s AS (SELECT key, sum(weight * (tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * doc_len / (tokens::DOUBLE / docs))))) AS score FROM p JOIN t USING (term), st GROUP BY key) SELECT key FROM s ORDER BY score DESC, key LIMIT 6""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
