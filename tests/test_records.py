import pytest

from memloom.engine import Engine, EngineError
from memloom.operators import oplog, records
from memloom.operators.oplog import NamespaceState
from memloom.plans.search import Filters, SearchQuery
from memloom.sources.config import Namespace, Policy, PolicyError, parse_policy

LOG = "namespace string, seq long, key string, op string, value binary, ttl_seconds long, condition string, now_ms long"


def put(state, key, now=0, ttl=None, condition="any", value=b"{}"):
    return state.put(key, value, ttl, condition, now)


def test_conditions_and_revisions_survive_deletes():
    s = NamespaceState(Namespace("n"))
    assert put(s, "a", condition="absent")[1].revision == 1
    assert put(s, "a", condition="absent")[0] == "conflict"
    assert s.delete("a", "1", 0)[0] is None
    assert s.delete("a", "any", 0)[0] == "not_found"
    assert put(s, "a")[1].revision == 2  # never reset
    assert put(s, "a", condition="1")[0] == "conflict"
    assert put(s, "a", condition="2")[1].revision == 3


def test_deadline_itself_is_past():
    s = NamespaceState(Namespace("n"))
    put(s, "a", now=10_000, ttl=1)
    assert s.live("a", 10_999) and not s.live("a", 11_000)
    assert len(s.entries) == 1  # counts until cleaned up
    assert s.cleanup(11_000, 100) == 1 and s.bytes == 0


def test_oldest_first_eviction_ignores_overwrites():
    s = NamespaceState(Namespace("n", mode="memory", on_full="evict_oldest", max_entries=2))
    put(s, "a")
    put(s, "b")
    put(s, "a")
    error, _, evicted = put(s, "c")
    assert error is None and evicted == ["a"] and set(s.entries) == {"b", "c"}


def test_quota_and_admission():
    s = NamespaceState(Namespace("n", max_entries=1, max_key_bytes=4, max_value_bytes=4))
    assert put(s, "toolong")[0] == "invalid"
    assert put(s, "__x")[0] == "invalid"
    assert put(s, "a", value=b"nojson")[0] == "invalid"
    assert put(s, "a", ttl=0)[0] == "invalid"
    put(s, "a")
    assert put(s, "b")[0] == "quota" and s.revision == 1


def test_fold_in_spark_equals_the_state(spark):
    ops = [("n", i, f"k{i % 5}", "delete" if i % 7 == 3 else "put", b'{"i": %d}' % i, None, "any", i) for i in range(40)]
    df = spark.createDataFrame(ops, LOG)
    policy = Namespace("n")
    s = NamespaceState(policy)
    for _, _, key, op, value, _, _, now in ops:
        put(s, key, now, value=value) if op == "put" else s.delete(key, "any", now)
    got = {r["key"]: (bytes(r["value"]), r["revision"]) for r in oplog.fold_records(df, policy).collect()}
    assert got == {k: (e.value, e.revision) for k, e in s.entries.items()}
    last = oplog.fold_outcomes(df, policy).orderBy("seq").collect()[-1]
    assert (last["entries"], last["bytes"]) == (len(s.entries), s.bytes)


def test_scans(spark):
    rows = [("n", f"a/{i}", b"xx", i, 0, 100 if i == 2 else None, i) for i in range(5)]
    df = spark.createDataFrame(rows, oplog.RECORD)
    page = records.list_page(df, "n", "a/", 100, "a/0", 2).collect()
    assert [(r["key"], r["bytes"]) for r in page] == [("a/1", 2), ("a/3", 2)]
    assert records.get(df, "n", "a/2", 99).count() == 1 and records.get(df, "n", "a/2", 100).count() == 0
    assert [r["key"] for r in records.expired_batch(df, 100, 5).collect()] == ["a/2"]
    assert records.usage(df).first()["bytes"] == 25
    assert {r["key"] for r in records.fifo_kept(df, 2, 100).collect()} == {"a/3", "a/4"}


def test_engine_round_trip(spark):
    policy = Policy((Namespace("knowledge"),), grants=(("ann", "knowledge", "get"), ("ann", "knowledge", "list")))
    empty = spark.createDataFrame([], LOG)
    memory = lambda text, at: Engine.envelope(text, " Topic ", ["B", "b"], {"x": 1}, at)
    rows = [("knowledge", i, f"m{i}", "put", memory(text, i), None, "any", 10) for i, text in enumerate(("red apples", "green apple", "blue sky"))]
    engine = Engine(spark, policy, empty, 100).append(rows)
    hits, more = engine.search("knowledge", SearchQuery("apple", Filters(topic="topic", tag="b"), limit=1))
    assert [h["key"] for h in hits] == ["m0"] and more
    hits, _ = engine.search("knowledge", SearchQuery("apple", Filters(topic="topic", tag="b"), limit=1), more)
    assert [h["key"] for h in hits] == ["m1"]
    found, _ = engine.recall("knowledge", limit=2)
    assert [m["key"] for m in found] == ["m2", "m1"]
    keys, cursor = engine.list("knowledge", "m", limit=2)
    assert [k["key"] for k in keys] == ["m0", "m1"] and [k["key"] for k in engine.list("knowledge", "m", cursor)[0]] == ["m2"]
    assert engine.usage("knowledge")["revision"] == 3
    for code, act in (("not_found", lambda: engine.get("knowledge", "none")), ("namespace_not_found", lambda: engine.get("none", "m0"))):
        with pytest.raises(EngineError) as error:
            act()
        assert error.value.code == code
    ann = Engine(spark, policy, engine.log, 100, "ann")
    assert ann.memory_get("knowledge", "m0")["tags"] == ["b"]
    with pytest.raises(EngineError):
        ann.usage("knowledge")


def test_policies():
    text = """
[[namespaces]]
name = "scratch"
mode = "memory"
on_full = "evict_oldest"
require_ttl = true
default_ttl_seconds = 300
max_ttl_seconds = 3600
[[grants]]
principal = "ann"
namespace = "scratch"
operations = ["get", "put"]
"""
    policy = parse_policy(text)
    assert policy.namespace("scratch").ttl(None) == (300, None) and policy.namespace("scratch").ttl(4000) == (None, "invalid")
    for bad in (Namespace("a b"), Namespace("n", on_full="evict_oldest"), Namespace("n", max_ttl_seconds=5), Namespace("n", purpose="checkpoints", require_ttl=True)):
        with pytest.raises(PolicyError):
            bad.validate()
    with pytest.raises(PolicyError):
        parse_policy('[[namespaces]]\nname = "n"\nunknown = 1')


def test_operations_one_by_one(spark):
    policy = Policy((Namespace("knowledge"), Namespace("saves", purpose="checkpoints")))
    engine = Engine(spark, policy, now_ms=10_000)
    engine, row = engine.remember("knowledge", "m", "a fact", "topic", ["x"], occurred_at_ms=5)
    assert row["revision"] == 1
    engine, _ = engine.put("knowledge", "raw", b"{}", 1)
    for code, act in (
        ("conflict", lambda: engine.remember("knowledge", "m", "again", "topic")),
        ("invalid", lambda: engine.remember("knowledge", "n", "", "topic")),
        ("not_found", lambda: engine.forget("knowledge", "raw")),
        ("not_found", lambda: engine.at(11_000).delete("knowledge", "raw")),
        ("invalid", lambda: engine.checkpoint("knowledge", "c", "a", "s", {})),
        ("invalid", lambda: engine.checkpoint("saves", "c", "a", "s", {"goal": ""})),
    ):
        with pytest.raises(EngineError) as error:
            act()
        assert error.value.code == code
    later, removed = engine.at(11_000).cleanup("knowledge")
    assert removed == 1 and later.usage("knowledge")["entries"] == 1
    capsule = {"goal": "g", "summary": "s", "next_action": "n"}
    refs = [{"namespace": "knowledge", "key": "m", "revision": 1}, {"namespace": "knowledge", "key": "none", "revision": 1}]
    engine, receipt = engine.checkpoint("saves", "c1", "a", "s", capsule, refs)
    assert receipt["is_latest"] and receipt["latest_revision"] == 2
    engine, _ = engine.checkpoint("saves", "c2", "a", "s", capsule, [], 2)
    assert engine.restore_latest("saves", "a", "s")["checkpoint_id"] == "c2"
    old = engine.restore("saves", "c1")
    assert [r["status"] for r in old["references"]] == ["available", "missing"] and old["latest_revision"] == 4
    engine, _ = engine.forget("knowledge", "m")
    assert [r["status"] for r in engine.restore("saves", "c1")["references"]] == ["missing", "missing"]
