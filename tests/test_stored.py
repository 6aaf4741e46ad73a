"""The stored index: against the scan, its updates, its plans; pages, generations and budgets of the engine."""

import re

import pytest
from pyspark.sql import functions as F

from memloom import queries as base
from memloom.engine import Engine, EngineError
from memloom.operators import evaluation, ledger, lifecycle, oplog
from memloom.plans import cursor
from memloom.plans.search import Filters, SearchQuery, recall_candidates, search, search_counters
from memloom.plans.stored import SearchIndex
from memloom.sources import sinks
from memloom.sources.config import Limits, Namespace, Policy

SCHEMA = "namespace string, key string, content string, topic string, tags array<string>, occurred_at_ms long, written_at_ms long, expires_at_ms long, revision long"


def frame(spark, rows):
    return spark.createDataFrame([("k", key, text, topic, ["local"], at, at, expires, 1) for key, text, topic, at, expires in rows], SCHEMA)


def hits(df):
    return [(r["key"], r["score"]) for r in df.collect()]


QUERIES = (
    SearchQuery("river copper"),
    SearchQuery("rivers of coppers", Filters("t", from_ms=3)),
    SearchQuery("river copper", stemmed=False, limit=3),
    SearchQuery("ban", expand=True, expansion_terms=("stone",)),
    SearchQuery("unknown words"),
    SearchQuery(" ".join(f"w{i}" for i in range(90)) + " w1 w2", stemmed=False),
)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"d{i:03d}", " ".join(["river"] * (i % 3) + ["coppers"] * (i % 5) + [f"w{i}", "prohibit" if i % 7 == 0 else "stones"]), "t" if i % 2 else "u", i, 50 if i % 11 == 0 else None) for i in range(120)]
    return frame(spark, [*rows, ("empty", "", "t", 1, None), ("null", None, "t", 1, None), ("stop", "the of", "t", 1, None)]).repartition(3)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.text[:12])
def test_index_equals_the_scan_to_the_last_bit(spark, corpus, tmp_path, query):
    index = SearchIndex.build(corpus, f"file://{tmp_path}/i")
    assert hits(index.search(corpus, query, 60)) == hits(search(corpus, query, 60))
    assert index.counters(query).first() == search_counters(corpus, query).first()
    page = hits(search(corpus, query, 60))
    if len(page) > 3:
        after = SearchQuery(**{**query.__dict__, "after": (page[2][1], page[2][0])})
        assert hits(index.search(corpus, after, 60))[: len(page) - 3] == page[3:]


def test_updates_equal_a_new_index(spark, corpus, tmp_path):
    index = SearchIndex.build(corpus, f"file://{tmp_path}/i")
    changed = frame(spark, [("d001", "river river stones", "t", 1, None), ("new", "copper rivers", "t", 9, None)])
    once = index.update(changed, corpus.where("key in ('d002', 'd003', 'none')"))
    twice = once.update(removed=spark.createDataFrame([("new",)], "key string"))
    state = corpus.where("key not in ('d001', 'd002', 'd003')")
    for own, now in ((index, corpus), (once, state.unionByName(changed)), (twice, state.unionByName(changed.where("key != 'new'")))):
        fresh = SearchIndex.build(now, f"file://{tmp_path}/fresh{own.generation}")
        assert own.figures() == fresh.figures()
        for q in QUERIES[:2]:
            assert hits(own.search(now, q, 60)) == hits(fresh.search(now, q, 60))
    assert (index.generation, once.generation, twice.generation) == (0, 1, 2) and index.update() is index


def test_scan_reads_only_the_terms_postings(spark, corpus, tmp_path):
    index = SearchIndex.build(corpus, f"file://{tmp_path}/i", text_bytes=16 << 26)
    assert index.buckets == 16
    plan = index.postings(["river"], stemmed=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term,river)" in plan
    read = {re.search(r"bucket=(-?\d+)", f)[1] for f in index.postings(["river"], stemmed=False).inputFiles()}
    every = {re.search(r"bucket=(-?\d+)", f)[1] for f in index.rows().inputFiles()}
    assert "-1" in every and len(every) > 8
    partitions = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)[1]
    assert "bucket" in partitions and "text" not in plan and read <= every
    tokens = index.postings(["river"], stemmed=False)
    assert {r["term"] for r in tokens.collect()} == {"river"}


def test_empty_index(spark, tmp_path):
    index = SearchIndex.build(frame(spark, []), f"file://{tmp_path}/i")
    assert index.figures() == (0, 0) and index.search(frame(spark, []), SearchQuery("word"), 1).count() == 0
    assert index.batch(spark.createDataFrame([(1, "word")], "query_id long, text string"), 5).count() == 0


# ---------------------------------------------------------------- engine


POLICY = Policy((Namespace("knowledge"),), Limits(max_candidates=2, max_result_bytes=4096))


def engine_of(spark, texts):
    rows = [("knowledge", i, key, "put", Engine.envelope(text, "work", [], occurred_at_ms=i), None, "any", 100) for i, (key, text) in enumerate(texts)]
    return Engine(spark, POLICY, now_ms=100).append(rows)


def test_a_cursor_ends_with_the_next_write(spark, tmp_path):
    engine = engine_of(spark, [(k, "Rust local tools") for k in ("a", "b", "\U0001f600")])
    q = SearchQuery("Rust", limit=1)
    page, more = engine.search("knowledge", q)
    assert [h["key"] for h in page] == ["a"]
    page, more = engine.search("knowledge", q, more)
    assert [h["key"] for h in page] == ["b"]
    with pytest.raises(cursor.CursorError):
        engine.search("knowledge", SearchQuery("local", limit=1), more)
    page, last = engine.search("knowledge", q, more)
    assert [h["key"] for h in page] == ["\U0001f600"] and last is None
    after, _ = engine.remember("knowledge", "new", "Rust tools", "work")
    assert after.generation("knowledge") == engine.generation("knowledge") + 1
    with pytest.raises(cursor.CursorError):
        after.search("knowledge", q, more)
    index = engine.index("knowledge", f"file://{tmp_path}/i")
    page, more = engine.search("knowledge", q, index=index)
    assert [h["key"] for h in engine.search("knowledge", q, more, index=index)[0]] == ["b"]
    with pytest.raises(cursor.CursorError):
        engine.search("knowledge", q, more, index=index.update(removed=spark.createDataFrame([("b",)], "key string")))


def test_pages_end_at_their_byte_budget(spark):
    engine = engine_of(spark, [(f"m{i}", "word " * 120) for i in range(5)])
    first, more = engine.recall("knowledge", max_bytes=2048)
    assert [h["key"] for h in first] == ["m4", "m3"] and more
    second, more = engine.recall("knowledge", max_bytes=2048, cursor=more)
    assert [h["key"] for h in second] == ["m2", "m1"]
    assert engine.recall("knowledge", max_bytes=2048, cursor=more) == (engine.recall("knowledge", max_bytes=4096, cursor=more)[0], None)
    found, more = engine.search("knowledge", SearchQuery("word"), max_bytes=2048)
    assert len(found) == 2 and len(engine.search("knowledge", SearchQuery("word"), more, max_bytes=4096)[0]) == 3
    large = engine_of(spark, [("m", "word " * 400)])
    for act in (lambda: large.recall("knowledge", max_bytes=1024), lambda: large.search("knowledge", SearchQuery("word"), max_bytes=1024)):
        with pytest.raises(cursor.CursorError):
            act()
    for size in (1023, 4097):
        with pytest.raises(EngineError):
            engine.recall("knowledge", max_bytes=size)


def test_bounded_recall_may_give_an_empty_page(spark):
    engine = engine_of(spark, [("a", "needle"), ("b", "hay"), ("c", "hay"), ("d", "needle"), ("e", "hay")])
    page, more = engine.recall("knowledge", query="needle", bounded=True, max_bytes=4096)
    assert [h["key"] for h in page] == ["d"] and more
    page, more = engine.recall("knowledge", query="needle", bounded=True, cursor=more, max_bytes=4096)
    assert page == [] and more
    page, more = engine.recall("knowledge", query="needle", bounded=True, cursor=more, max_bytes=4096)
    assert [h["key"] for h in page] == ["a"] and more is None
    found, last = recall_candidates(engine.memories("knowledge"), 100, Filters(), "needle", 4)
    assert [r["key"] for r in found.collect()] == ["d"] and last.first()["key"] == "b"


def test_open_refuses_lost_namespaces(spark):
    log = engine_of(spark, [("a", "x")]).log
    schema = "namespace string, mode string, purpose string"
    Engine.open(spark, POLICY, log, spark.createDataFrame([("knowledge", "durable", "records")], schema))
    for row in (("gone", "durable", "records"), ("knowledge", "memory", "records"), ("knowledge", "durable", "checkpoints")):
        with pytest.raises(EngineError):
            Engine.open(spark, POLICY, log, spark.createDataFrame([row], schema))
    with pytest.raises(EngineError):
        Engine.open(spark, POLICY, log, spark.createDataFrame([("knowledge",)], "namespace string"))


def test_log_is_written_and_labels_are_checked(spark, tmp_path):
    engine = engine_of(spark, [("a", "x")])
    for i in range(12):
        engine = engine.append([("knowledge", 10 + i, f"k{i}", "put", b"{}", None, "any", 100)])
    assert engine.log._jdf.queryExecution().analyzed().toString().count("Union") == 1
    stored = engine.stored(f"file://{tmp_path}/log")
    assert sorted(map(str, stored.log.collect())) == sorted(map(str, engine.log.collect())) and not stored.added
    for bad in ({"topic": "a\tb"}, {"tags": ["x\u0085y"]}, {"metadata": {"a": "é" * 5000}}):
        with pytest.raises(EngineError):
            engine.remember("knowledge", "n", "text", **({"topic": "t"} | bad))
    assert engine.remember("knowledge", "n", "text", "t", metadata={"a": "é" * 4000})[1]["error_code"] is None


def test_checkpoints_but_the_latest_can_go(spark):
    engine = Engine(spark, Policy((Namespace("saves", purpose="checkpoints"),)), now_ms=1)
    capsule = {"goal": "g", "summary": "s", "next_action": "n"}
    engine, _ = engine.checkpoint("saves", "c1", "a", "s", capsule)
    engine, _ = engine.checkpoint("saves", "c2", "a", "s", capsule, [], 2)
    for code, id in (("conflict", "c2"), ("not_found", "c3")):
        with pytest.raises(EngineError) as error:
            engine.delete_checkpoint("saves", id)
        assert error.value.code == code
    after = engine.delete_checkpoint("saves", "c1")
    assert after.restore("saves", "c2")["checkpoint_id"] == "c2" and engine.restore("saves", "c1")
    for act in (lambda: after.restore("saves", "c1"), lambda: after.delete_checkpoint("saves", "c1")):
        with pytest.raises(EngineError):
            act()


# ---------------------------------------------------------------- lifecycle, ledgers, figures


def test_proposals_are_checked_in_full(spark):
    from memloom.operators.admission import PROPOSAL_COLUMNS, proposal_error

    good = dict(zip(PROPOSAL_COLUMNS, ("me", "ann", "city", 1, "assert", "Rome", "fact", "s1", "said so", "user", 5, None, None), strict=True))
    cases = {
        "missing_field": [{"entity": "\t\u2003"}, {"value": None}, {"source_text": " "}, {"occurred_at_ms": None}],
        "over_limit": [{"value": "x" * 50_000}, {"entity": "é" * 65}, {"source_id": "s" * 257}, {"source_text": "x" * 513}],
        "control_character": [{"attribute": "a\u0007b"}],
        "invalid_operation": [{"operation": "guess"}, {"operation": None}],
        "invalid_kind": [{"kind": "rumour"}, {"kind": None}],
        "invalid_role": [{"source_role": "assistant"}, {"source_role": None}],
        "invalid_expiry": [{"valid_until_ms": 5}, {"occurred_at_ms": -1}],
        "missing_revision": [{"operation": "correct"}, {"operation": "correct", "expected_revision": 0}],
        "unexpected_revision": [{"expected_revision": 1}],
        None: [{}, {"operation": "correct", "expected_revision": 3}, {"valid_until_ms": 6}, {"entity": " \tann\n"}],
    }
    schema = "scope string, entity string, attribute string, seq long, operation string, value string, kind string, source_id string, source_text string, source_role string, occurred_at_ms long, valid_until_ms long, expected_revision long"
    rows = [(code, good | change) for code, changes in cases.items() for change in changes]
    df = spark.createDataFrame([tuple((r | {"seq": i}).values()) for i, (_, r) in enumerate(rows)], schema)
    assert [r["error_code"] for r in proposal_error(df).orderBy("seq").collect()] == [code for code, _ in rows]
    with pytest.raises(ValueError):
        proposal_error(df.withColumn("mood", F.lit("x")))
    assert "mood" in proposal_error(df.withColumn("mood", F.lit("x")), ("mood",)).columns


def test_context_against_plain_loops(spark, sf_dir):
    """Hits are active facts that share a word with the query, best first."""
    got = base.l08_context(spark, sf_dir).collect()
    slots = [r for r in base.l03_slots(spark, sf_dir).collect() if r["state"] == "active"]
    want = {(r["entity"], r["attribute"]) for r in slots if {"high", "purchase", "user"} & set(re.findall(r"[a-z]+", r["content"]))}
    assert {(r["entity"], r["attribute"]) for r in got} == want or (len(got) == 100 and {(r["entity"], r["attribute"]) for r in got} <= want)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_budgeted_profile(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(5)], "n long, v string")
    every = lifecycle.within_bytes(df, [F.asc("n")], 1000, "n", "v").collect()
    assert [r["n"] for r in every] == list(range(5)) and not any(r["truncated"] for r in every)
    import json

    size = len(json.dumps({"items": [{"n": i, "v": "x" * 10} for i in range(3)], "truncated": False}, separators=(",", ":")))
    assert [r["n"] for r in lifecycle.within_bytes(df, [F.asc("n")], size, "n", "v").collect()] == [0, 1, 2]
    assert [r["n"] for r in lifecycle.within_bytes(df, [F.asc("n")], size - 1, "n", "v").collect()] == [0, 1]
    with pytest.raises(ValueError):
        lifecycle.within_bytes(df, [F.asc("n")], 5, "n")


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_plain_logs_need_no_ordered_fold(spark, sf_dir, block):
    ops = base.operations(spark, sf_dir).where("op != 'cleanup'").withColumns({"condition": F.lit("any"), "ttl_seconds": F.lit(None).cast("long")})
    columns = ("namespace", "key", "value", "revision", "written_at_ms", "inserted")
    fold, plain = (sorted(map(tuple, df.select(*columns).collect())) for df in (oplog.fold_records(ops, base.PLAIN), oplog.plain_records(ops, base.PLAIN, block)))
    assert fold == plain and fold


def test_trailing_windows_over_slots(spark):
    import random

    rng = random.Random(4)
    rows = [("a", i, round(rng.uniform(0, 50), 3), rng.randint(1, 9)) for i in range(300)] + [("b", 300 + i, float(i * 5), 1) for i in range(20)]
    df = spark.createDataFrame(rows, "account string, seq long, at double, units long")
    got = {r["seq"]: (r["n"], r["total"]) for r in ledger.trailing(df, 5).collect()}
    for account, seq, at, _ in rows:
        own = [u for a, _, t, u in rows if a == account and at - 5 <= t <= at]
        assert got[seq] == (len(own), sum(own))


def test_figures_without_positives_are_null(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 12), ("r", "a", 1)], "query_id string, doc_id string, rank long")
    qrels = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("s", "x", 0), ("t", "c", 1)], "query_id string, doc_id string, gain int")
    queries = spark.createDataFrame([(x,) for x in "qrst"], "query_id string")
    got = {r["query_id"]: r.asDict() for r in evaluation.ranking_figures(ranked, qrels, queries).collect()}
    assert got["q"]["recall_10"] == 0 and got["q"]["mrr"] == pytest.approx(1 / 12) and got["q"]["ndcg"] == 0
    assert all(got[x]["mrr"] is None and got[x]["recall_1"] is None for x in "rs") and got["t"]["mrr"] == 0
    docs = spark.createDataFrame([("b",), ("x",)], "doc_id string")
    assert evaluation.answerable(queries, qrels, docs).collect() == []
    assert [r["query_id"] for r in evaluation.answerable(queries, qrels, docs.union(docs.sparkSession.createDataFrame([("c",)], "doc_id string"))).orderBy("query_id").collect()] == ["q", "t"]


def test_paged_fetches():
    pages = {1: [{"id": 1}, {"id": 2}], 2: [{"id": 3}, {"id": 4}], 3: [{"id": 5}]}
    assert [r["id"] for r in sinks.fetch_pages(pages.get, "id", 2)] == [1, 2, 3, 4, 5]
    assert sinks.fetch_pages(lambda n: [], "id") == []
    for broken in (lambda n: [{"id": n}, {"id": 1}], lambda n: {"error": "x"}, lambda n: [{"id": 2 * n}, {"id": 2 * n + 1}]):
        with pytest.raises(ValueError):
            sinks.fetch_pages(broken, "id", 2, most=5)


def test_clusters_have_to_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        sinks.shared_path(Session(), "x")
