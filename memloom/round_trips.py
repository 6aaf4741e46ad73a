"""Queries that write driver tables in a corpus' or a sink's format, read them back, and drive the engine's
handle; each with the same in SQL."""

from __future__ import annotations

import atexit
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.text import ChunkText
from .operators import checkpoints, evaluation, ledger, lifecycle
from .plans.search import Filters, SearchQuery
from .sources import readers, sinks
from .sources.config import Namespace, Policy, parse_policy

#: Files that hold several conversations each, where a format wants one JSON array a file.
FILES = 32
DATE = "1:56 pm on 8 May, 2023"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    path = sinks.shared_path(spark, name)
    atexit.register(sinks.remove, spark, path)
    return path


def _arrays(rows: DataFrame, number: str, path: str) -> str:
    """Rows as JSON arrays, a file for each of FILES groups."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != number]))
    grouped = rows.select((F.col(number) % FILES).alias("file"), body.alias("row")).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("row"), ","), F.lit("]")).alias("value"))
    grouped.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns in order."""
    turn = F.struct("turn", "role", "text")
    return _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _beir(spark, sf):
    root = _folder(spark, "beir")
    d, b = _read(spark, sf, "documents"), _read(spark, sf, "benchmark")
    title = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source"))
    d.select(F.col("doc_id").cast("string").alias("_id"), title.alias("title"), "text").write.json(f"{root}/corpus")
    b.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{root}/queries")
    pairs = d.select((F.col("doc_id") % 50).alias("item"), F.col("doc_id").cast("string").alias("corpus-id"), (F.col("doc_id") % 4 - 1).alias("score"))
    pairs.select(F.col("item").cast("string").alias("query-id"), "corpus-id", "score").write.option("header", True).option("sep", "\t").csv(f"{root}/qrels")
    return readers.beir(spark, f"{root}/corpus", f"{root}/queries", f"{root}/qrels", "s", exclude_self=True)


def io01_beir_documents(spark, sf):
    return _beir(spark, sf)[0].select("doc_id", "scope", F.md5("content").alias("md5"))


def io02_beir_queries(spark, sf):
    q = _beir(spark, sf)[1]
    gains = F.aggregate(F.map_values("relevant"), F.lit(0), lambda s, x: s + x)
    return q.select("query_id", F.size("relevant").alias("n"), gains.cast("long").alias("gains"), "exclude_id")


def _sessions(spark, sf):
    turn = F.transform("turns", lambda t: F.struct(F.concat(F.lit("D1:"), t["turn"].cast("string")).alias("dia_id"), t["role"].alias("speaker"), t["text"].alias("text")))
    held = F.struct(F.lit(DATE).alias("session_1_date_time"), turn.alias("session_1"))
    asked = lambda q, e, c: F.struct(F.lit(q).alias("question"), F.array(F.lit(e)).alias("evidence"), F.lit(c).alias("category"))
    qa = F.array(asked("who", "D1:0; D1:0", 4), asked("what", "D9:9", 1), asked("none", "D1:0", 5))
    rows = _turns(spark, sf).select("conv_id", F.col("conv_id").cast("string").alias("sample_id"), held.alias("conversation"), qa.alias("qa"))
    return readers.sessions(spark, _arrays(rows, "conv_id", _folder(spark, "sessions")))


def io03_session_documents(spark, sf):
    return _sessions(spark, sf)[0].select("scope", "doc_id", F.md5("content").alias("md5"), "event_ms")


def io04_session_queries(spark, sf):
    return _sessions(spark, sf)[1].select("query_id", "category", F.size("relevant").alias("n"))


def _haystacks(spark, sf):
    turn = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    part = lambda odd: F.transform(F.filter("turns", lambda t: t["turn"] % 2 == odd), turn)
    kind = F.concat(F.lit("q"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 5 == 0, "_abs").otherwise(""))
    rows = _turns(spark, sf).select(
        "conv_id", kind.alias("question_id"), F.lit("why").alias("question"), F.lit("type").alias("question_type"), F.lit("d").alias("question_date"),
        F.array(F.when(F.col("conv_id") % 3 == 0, "none").otherwise("a")).alias("answer_session_ids"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("haystack_session_ids"),
        F.array(F.lit("d1"), F.lit("d2"), F.lit("d3")).alias("haystack_dates"), F.array(part(0), part(1), part(1)).alias("haystack_sessions"),
    )
    return readers.haystacks(spark, _arrays(rows, "conv_id", _folder(spark, "haystacks")))


def io05_haystack_documents(spark, sf):
    return _haystacks(spark, sf)[0].select("scope", "doc_id", F.md5("content").alias("md5"))


def io06_haystack_queries(spark, sf):
    return _haystacks(spark, sf)[1].select("query_id", "category", F.size("relevant").alias("n"))


def _trajectories(spark, sf):
    root = _folder(spark, "trajectories")
    step = F.transform("turns", lambda t: F.struct(t["turn"].cast("int").alias("turn_idx"), t["role"].alias("action"), t["text"].alias("observation")))
    qa = F.array(F.struct(F.lit("u").alias("question_uuid"), F.lit("how").alias("question")))
    rows = _turns(spark, sf).select(F.col("conv_id").cast("string").alias("episode_id"), F.lit("Task").alias("task"), F.lit("kind").alias("task_type"), step.alias("trajectory"), qa.alias("qa_pairs"))
    rows.write.json(root)
    return readers.trajectories(spark, root)


def io07_trajectory_documents(spark, sf):
    return _trajectories(spark, sf)[0].select("scope", "doc_id", F.md5("content").alias("md5"))


def io08_chat_documents(spark, sf):
    """Chats whose turns come in numbered groups: the even ones, then the odd ones."""
    root = _folder(spark, "chats")
    turn = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    part = lambda odd: F.transform(F.filter("turns", lambda t: t["turn"] % 2 == odd), turn)
    chat = F.struct(F.struct(part(1).alias("turns")).alias("group10"), part(0).alias("group2"))
    probes = F.lit("{'cat': [{'question': 'why'}]}")
    _turns(spark, sf).select(F.col("conv_id").alias("conversation_id"), F.to_json(chat).alias("chat"), probes.alias("probing_questions")).write.parquet(root)
    docs, _ = readers.chats(spark, root, "1k")
    return docs.select("scope", F.col("doc_id").cast("long").alias("place"), F.md5("content").alias("md5"))


def io09_grouped_haystacks(spark, sf):
    """Questions by the list of documents that they share; how many documents each case has and lacks."""
    d, b = _read(spark, sf, "documents"), _read(spark, sf, "benchmark")
    name = F.col("item_id").cast("string")
    ids = F.array(*((F.col("item_id") % 5 * k).cast("string") for k in (1, 2, 7000000)))
    cases, held = readers.grouped_haystacks(b.select(name.alias("question_id")), b.select(name.alias("question_id"), ids.alias("ids")), d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")))
    sizes = held.groupBy("case_id").agg(F.count("*").alias("n"))
    lost = readers.missing(held).groupBy("case_id").agg(F.count("*").alias("lost"))
    return cases.join(sizes, "case_id").join(lost, "case_id", "left").select("question_id", "n", F.coalesce("lost", F.lit(0)).alias("lost"))


def io10_copied_table(spark, sf):
    root = _folder(spark, "copy")
    n = sinks.copy_table(spark, f"{sf.rstrip('/')}/documents.parquet", root)
    return spark.read.parquet(root).select("doc_id", F.md5("text").alias("md5"), F.lit(n).cast("long").alias("n"))


def io11_export(spark, sf):
    root = _folder(spark, "export")
    b = _read(spark, sf, "benchmark")
    sinks.export_checked(b, root, b.count(), ["item_id"])
    return spark.read.schema("item_id long, text string, sha256 string").json(root).select("item_id", F.md5("text").alias("md5"), "sha256")


def io12_snapshots(spark, sf):
    """Two snapshots of a table and the lines of a log, appended."""
    root, lines = _folder(spark, "snapshots"), _folder(spark, "lines")
    n = _read(spark, sf, "nation")
    for k in (1, 2):
        sinks.append_snapshot(n.where(F.col("n_nationkey") % k == 0), root, k)
        sinks.write_lines(n.where(F.col("n_nationkey") % k == 0).select("n_name"), lines)
    logged = spark.read.schema("n_name string").json(lines).groupBy("n_name").agg(F.count("*").alias("logged"))
    return spark.read.parquet(root).groupBy("n_name").agg(F.count("*").alias("n"), F.max("snapshot_id").cast("long").alias("latest")).join(logged, "n_name")


def io13_report(spark, sf):
    """A report, replaced whole."""
    path = f"{_folder(spark, 'report')}/report.json"
    for rows in (0, _read(spark, sf, "region").count()):
        sinks.write_report(spark, {"rows": rows, "name": "régions"}, path)
    return spark.read.option("multiLine", True).schema("rows long, name string").json(path)


POLICY = Policy((Namespace("knowledge", max_entries=1 << 30, max_total_bytes=1 << 50), Namespace("saves", purpose="checkpoints")), grants=(("ann", "knowledge", "get"), ("ann", "knowledge", "list"), ("ann", "saves", "get")))


def _engine(spark, sf, now_ms: int = 10_000_000) -> Engine:
    """An engine whose log remembers every benchmark passage, its topic even or odd."""
    b = _read(spark, sf, "benchmark")
    body = F.struct(F.lit(1).alias(Engine.MEMORY), F.col("text").alias("content"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("topic"), F.array().cast("array<string>").alias("tags"), F.col("item_id").alias("occurred_at_ms"))
    none = F.lit(None)
    log = b.select(
        F.lit("knowledge").alias("namespace"), F.col("item_id").alias("seq"), F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("key"), F.lit("put").alias("op"),
        F.to_json(body).cast("binary").alias("value"), none.cast("long").alias("ttl_seconds"), F.lit("any").alias("condition"), F.lit(1_000).cast("long").alias("now_ms"),
    )
    return Engine(spark, POLICY, log, now_ms)


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    """A page of a handle, 100 rows at most."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def en01_engine_recall(spark, sf):
    """The second page of recall through the handle, behind a write."""
    engine, _ = _engine(spark, sf).remember("knowledge", "item/new", "a new thing", " ODD", occurred_at_ms=9_000_000)
    engine, _ = engine.forget("knowledge", "item/3")
    page, more = engine.recall("knowledge", Filters(topic="odd"), limit=4, max_bytes=65_536)
    page, _ = engine.recall("knowledge", Filters(topic="odd"), limit=4, cursor=more, max_bytes=65_536)
    return _rows(spark, page, "key string, occurred_at_ms long, revision long")


def en02_engine_list(spark, sf):
    engine, _ = _engine(spark, sf).put("knowledge", "item/0", b"{}", 5)
    engine, _ = engine.delete("knowledge", "item/1")
    page, more = engine.list("knowledge", "item/1", limit=5)
    page += engine.list("knowledge", "item/1", more, limit=5)[0]
    return _rows(spark, page, "key string, revision long")


def en03_engine_usage(spark, sf):
    """Usage behind an overwrite, a delete and the cleanup of an expired record."""
    engine, _ = _engine(spark, sf).put("knowledge", "item/0", b"{}", 5)
    engine, _ = engine.delete("knowledge", "item/1")
    engine, removed = engine.at(engine.now_ms + 5_000).cleanup("knowledge")
    return _rows(spark, [engine.usage("knowledge") | {"removed": removed, "generation": engine.generation("knowledge")}], "namespace string, entries long, revision long, removed long, generation long")


def en04_engine_search(spark, sf):
    """Both pages of a ranked search through the handle equal one page without a cursor."""
    engine = _engine(spark, sf)
    q = SearchQuery("tion heat thing", limit=3, stemmed=False)
    first, more = engine.search("knowledge", q, max_bytes=65_536)
    second = engine.search("knowledge", q, more, max_bytes=65_536)[0] if more else []
    return _rows(spark, first + second, "key string")


def en05_engine_restore(spark, sf):
    """A checkpoint with references to a kept, a changed and a lost memory, restored by another principal."""
    engine = _engine(spark, sf)
    refs = [{"namespace": "knowledge", "key": k, "revision": r} for k, r in (("item/4", 5), ("item/5", 6), ("item/6", 7), ("none", 1))]
    engine, _ = engine.checkpoint("saves", "c1", "agent", "s", {"goal": "g", "summary": "s", "next_action": "n"}, refs)
    engine, _ = engine.put("knowledge", "item/5", b"{}")
    engine, _ = engine.delete("knowledge", "item/6")
    ann = engine._with(principal="ann")
    held = ann.restore_latest("saves", "agent", "s")
    rows = [{"key": r["key"], "status": r["status"], "revision": held["revision"], "latest": held["latest_revision"]} for r in held["references"]]
    return _rows(spark, rows, "key string, status string, revision long, latest long")


def io14_paged_fetch(spark, sf):
    """Rows of a paged source, ten a page."""
    rows = [{"id": r["n_nationkey"], "name": r["n_name"]} for r in _read(spark, sf, "nation").orderBy("n_nationkey").limit(100).collect()]
    found = sinks.fetch_pages(lambda page: rows[10 * page - 10 : 10 * page], "id", size=10)
    return spark.createDataFrame([(r["id"], r["name"]) for r in found], "id long, name string")


def cf01_policy(spark, sf):
    """Namespaces and grants of a policy text, with their effective TTL of an hour."""
    text = """
[[namespaces]]
name = "scratch"
mode = "memory"
on_full = "evict_oldest"
require_ttl = true
default_ttl_seconds = 300
max_ttl_seconds = 1800
[[namespaces]]
name = "kept"
[[grants]]
principal = "ann"
namespace = "kept"
operations = ["get", "put"]
"""
    policy = parse_policy(text)
    grants = Counter(g[1] for g in policy.grants)
    rows = [(n.name, n.mode, n.ttl(None)[0], n.ttl(3600)[1], grants[n.name]) for n in policy.namespaces]
    return spark.createDataFrame(rows, "name string, mode string, ttl long, hour string, grants long")


def d06_chunk_table(spark, sf):
    """Parts by the table function, which bounds characters and bytes."""
    d = _read(spark, sf, "documents").select("doc_id", "text")
    return d.lateralJoin(ChunkText(F.col("text").outer())).select("doc_id", F.col("part").cast("long").alias("part"), F.md5("content").alias("md5"))


def e14_unique_sources(spark, sf):
    """Ranked events reduced to the first of each user, a query's own user left out."""
    e = _read(spark, sf, "events")
    hits = e.select(F.col("event_type").alias("query_id"), F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("rank"), F.lit("7").alias("own"))
    return evaluation.unique_ranked(hits, "own").select("query_id", "doc_id", "rank")


def g11_accounted(spark, sf):
    e = _read(spark, sf, "events")
    calls = e.select(F.when(F.col("event_type") == "view", "reserved").otherwise("settled").alias("status"), F.ceil("value").cast("double").alias("reserved"), F.floor("value").cast("double").alias("charged"))
    return ledger.accounted(calls)


def c05_locators(spark, sf):
    """Receipts of two saves a conversation: the second one's locator is the latest."""
    c = _read(spark, sf, "conversations").select("conv_id").distinct()
    capsule = F.to_json(F.struct(F.lit("g").alias("goal"), F.lit("s").alias("summary"), F.lit("n").alias("next_action")))
    name = lambda p: F.concat(F.lit(p), F.col("conv_id").cast("string"))
    two = c.withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        name("n").alias("namespace"), F.col("seq").cast("long").alias("seq"), F.concat(name("c"), F.lit("-"), F.col("seq").cast("string")).alias("id"), F.lit("a").alias("agent_id"),
        name("s").alias("session_id"), capsule.alias("capsule"), F.lit("[]").alias("refs"), F.when(F.col("seq") == 1, F.lit(2)).cast("long").alias("expected_revision"),
    )
    return checkpoints.latest_checkpoints(checkpoints.fold_checkpoints(two)).select("namespace", "id", "locator", "latest_revision")


def _slot_operations(spark, sf, steps: list[tuple]) -> DataFrame:
    """For each user the same operations: (operation, value, role, time, expected revision or a column)."""
    users = _read(spark, sf, "events").select("user_id").distinct()
    none = F.lit(None).cast("long")
    step = lambda i, s: F.struct(
        F.lit(i).cast("long").alias("seq"), F.lit(s[0]).alias("operation"), F.lit(s[1]).alias("value"), F.lit(s[2]).alias("source_role"), F.lit(s[3]).cast("long").alias("occurred_at_ms"),
        (none if s[4] is None else F.lit(s[4]) if isinstance(s[4], int) else s[4]).cast("long").alias("expected_revision"),
    )
    rows = users.withColumn("s", F.explode(F.array(*(step(i, s) for i, s in enumerate(steps)))))
    return rows.select(
        F.lit("me").alias("scope"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("entity"), F.lit("city").alias("attribute"), "s.seq", "s.operation", "s.value", F.lit("fact").alias("kind"),
        F.concat(F.lit("s"), F.col("s.seq").cast("string")).alias("source_id"), F.lit("said").alias("source_text"), "s.source_role", "s.occurred_at_ms", none.alias("valid_until_ms"), "s.expected_revision",
    )


def l11_forget(spark, sf):
    """Even users forget their fact at the right revision, odd ones at a wrong one; then it is said again."""
    right = F.when(F.col("user_id") % 2 == 0, 1).otherwise(2)
    ops = _slot_operations(spark, sf, [("assert", "Rome", "user", 10, None), ("forget", None, "user", 20, right), ("assert", "Rome", "user", 30, None)])
    return lifecycle.fold_receipts(ops).select("entity", "seq", "status", "revision", "state")


def l12_batch(spark, sf):
    """A batch is validated first: a wrong role changes nothing, a second correction comes too late."""
    ops = _slot_operations(spark, sf, [("assert", "Rome", "user", 10, None), ("correct", "Bern", "user", 20, 1), ("assert", "Oslo", "assistant", 30, None), ("correct", "Oslo", "user", 40, 1), ("assert", "Bern", "user", 5, None)])
    return lifecycle.apply_batch(ops).select("entity", "seq", "status", "revision")


_LINE = "role || ': ' || text"
_PART = lambda odd: f"string_agg({_LINE}, chr(10) ORDER BY turn) FILTER (turn % 2 = {odd})"
_LAST = "(SELECT count(*) FROM benchmark)"

ROUND_TRIPS: dict[str, tuple[Callable, str | None]] = {
    "io01_beir_documents": (io01_beir_documents, "SELECT doc_id::VARCHAR AS doc_id, 's' AS scope, md5(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || chr(10) END || text) AS md5 FROM documents"),
    "io02_beir_queries": (
        io02_beir_queries,
        """SELECT item_id::VARCHAR AS query_id, count(*) AS n, sum(doc_id % 4 - 1)::BIGINT AS gains, item_id::VARCHAR AS exclude_id FROM benchmark JOIN documents ON doc_id % 50 = item_id WHERE doc_id % 4 > 1 GROUP BY item_id""",
    ),
    "io03_session_documents": (
        io03_session_documents,
        f"""SELECT conv_id::VARCHAR AS scope, 'D1:' || turn AS doc_id, md5('{DATE}' || chr(10) || {_LINE}) AS md5, 1683554160000 AS event_ms FROM conversations""",
    ),
    "io04_session_queries": (
        io04_session_queries,
        """SELECT conv_id || '/' || i AS query_id, ['single-hop', 'multi-hop', 'abstention'][i + 1] AS category, CASE WHEN i = 0 AND has THEN 1 END AS n FROM (SELECT conv_id, bool_or(turn = 0) AS has, unnest(range(3)) AS i FROM conversations GROUP BY conv_id)""",
    ),
    "io05_haystack_documents": (
        io05_haystack_documents,
        f"""WITH q AS (SELECT 'q' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '_abs' ELSE '' END AS scope, coalesce({_PART(0)}, '') AS e, coalesce({_PART(1)}, '') AS o FROM conversations GROUP BY conv_id)
 SELECT scope, 'a' AS doc_id, md5('d1' || chr(10) || e || chr(10) || 'd3' || chr(10) || o) AS md5 FROM q UNION ALL SELECT scope, 'b', md5('d2' || chr(10) || o) FROM q""",
    ),
    "io06_haystack_queries": (
        io06_haystack_queries,
        """SELECT DISTINCT 'q' || conv_id || CASE WHEN conv_id % 5 = 0 THEN '_abs' ELSE '' END AS query_id, CASE WHEN conv_id % 5 = 0 THEN 'abstention' ELSE 'type' END AS category, CASE WHEN conv_id % 3 <> 0 THEN 1 END AS n FROM conversations""",
    ),
    "io07_trajectory_documents": (
        io07_trajectory_documents,
        """SELECT conv_id::VARCHAR AS scope, turn::VARCHAR AS doc_id, md5('Task' || chr(10) || 'Action: ' || role || chr(10) || 'Observation: ' || text) AS md5 FROM conversations""",
    ),
    "io08_chat_documents": (
        io08_chat_documents,
        f"""SELECT '1k/' || conv_id AS scope, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn) - 1 AS place, md5(chr(10) || {_LINE}) AS md5 FROM conversations""",
    ),
    "io09_grouped_haystacks": (
        io09_grouped_haystacks,
        """SELECT item_id::VARCHAR AS question_id, 3::BIGINT AS n, (SELECT count(*) FROM (VALUES (1), (2), (7000000)) k(f) WHERE item_id % 5 * f NOT IN (SELECT doc_id FROM documents)) AS lost FROM benchmark""",
    ),
    "io10_copied_table": (io10_copied_table, "SELECT doc_id, md5(text) AS md5, (SELECT count(*) FROM documents) AS n FROM documents"),
    "io11_export": (io11_export, """SELECT item_id, md5(text) AS md5, sha256('{"item_id":' || item_id || '}') AS sha256 FROM benchmark"""),
    "io12_snapshots": (io12_snapshots, "SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS latest, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS logged FROM nation"),
    "io13_report": (io13_report, "SELECT count(*) AS rows, 'régions' AS name FROM region"),
    "io14_paged_fetch": (io14_paged_fetch, "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation"),
    "cf01_policy": (cf01_policy, "SELECT * FROM (VALUES ('scratch', 'memory', 300::BIGINT, 'invalid', 0::BIGINT), ('kept', 'durable', NULL, NULL, 2)) t(name, mode, ttl, hour, grants)"),
    "d06_chunk_table": (
        d06_chunk_table,
        """SELECT doc_id, s // 9500 AS part, md5(substring(text, s + 1, 9500)) AS md5 FROM (SELECT doc_id, text, unnest(range(0, length(text), 9500)) AS s FROM documents)""",
    ),
    "e14_unique_sources": (
        e14_unique_sources,
        """SELECT event_type AS query_id, user_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) AS rank FROM events WHERE user_id <> 7 GROUP BY event_type, user_id""",
    ),
    "g11_accounted": (g11_accounted, "SELECT sum(CASE WHEN event_type = 'view' THEN ceil(value) ELSE floor(value) END) AS accounted FROM events"),
    "c05_locators": (
        c05_locators,
        f"""SELECT DISTINCT 'n' || conv_id AS namespace, 'c' || conv_id || '-1' AS id, '{checkpoints.SCHEME}://n' || conv_id || '/checkpoints/c' || conv_id || '-1' AS locator, 4::BIGINT AS latest_revision FROM conversations""",
    ),
    "l11_forget": (
        l11_forget,
        """WITH u AS (SELECT DISTINCT user_id FROM events) SELECT 'user ' || user_id AS entity, s AS seq, CASE s WHEN 0 THEN 'created' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'forgotten' ELSE 'revision_conflict' END ELSE CASE WHEN user_id % 2 = 0 THEN 'forgotten' ELSE 'duplicate' END END AS status,
 CASE WHEN s = 0 OR (s = 1 AND user_id % 2 = 1) THEN 1 ELSE 2 END AS revision, CASE WHEN s > 0 AND user_id % 2 = 0 THEN 'forgotten' ELSE 'active' END AS state FROM u, (VALUES (0), (1), (2)) t(s)""",
    ),
    "l12_batch": (
        l12_batch,
        """WITH u AS (SELECT DISTINCT user_id FROM events) SELECT 'user ' || user_id AS entity, s AS seq, st AS status, r AS revision FROM u, (VALUES (0, 'created', 1), (1, 'corrected', 2), (2, 'invalid_role', NULL), (3, 'revision_conflict', 2), (4, 'stale', 3)) t(s, st, r)""",
    ),
    "en01_engine_recall": (
        en01_engine_recall,
        f"""WITH m AS (SELECT 'item/' || item_id AS key, item_id AS occurred_at_ms, item_id + 1 AS revision FROM benchmark WHERE item_id % 2 = 1 AND item_id <> 3 UNION ALL SELECT 'item/new', 9000000, {_LAST} + 1)
 SELECT * FROM m ORDER BY occurred_at_ms DESC, key DESC LIMIT 4 OFFSET 4""",
    ),
    "en02_engine_list": (en02_engine_list, "SELECT 'item/' || item_id AS key, item_id + 1 AS revision FROM benchmark WHERE starts_with(item_id::VARCHAR, '1') AND item_id <> 1 ORDER BY key LIMIT 10"),
    "en03_engine_usage": (en03_engine_usage, f"SELECT 'knowledge' AS namespace, {_LAST} - 2 AS entries, {_LAST} + 1 AS revision, 1 AS removed, {_LAST} + 3 AS generation"),
    "en04_engine_search": (en04_engine_search, None),
    "en05_engine_restore": (
        en05_engine_restore,
        "SELECT k AS key, s AS status, 1::BIGINT AS revision, 2::BIGINT AS latest FROM (VALUES ('item/4', 'available'), ('item/5', 'stale'), ('item/6', 'missing'), ('none', 'missing')) t(k, s)",
    ),
}
