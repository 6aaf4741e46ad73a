import json

from memloom import queries as base
from memloom.operators import checkpoints
from memloom.operators.checkpoints import CheckpointState

CAPSULE = json.dumps({"goal": "g", "summary": "s", "next_action": "n"})
OTHER = json.dumps({"goal": "g", "summary": "other", "next_action": "n"})


def test_identical_retry_moves_nothing():
    s = CheckpointState()
    assert s.save("c1", "a", "s", CAPSULE, "[]", None) == (None, 1, 2, True)
    assert s.save("c2", "a", "s", CAPSULE, "[]", 2) == (None, 3, 4, True)
    assert s.save("c1", "a", "s", CAPSULE, "[]", None) == (None, 1, 4, False)
    assert s.save("c1", "a", "s", OTHER, "[]", None)[0] == "conflict"
    assert s.save("c3", "a", "s", CAPSULE, "[]", 2)[0] == "conflict"
    assert s.save("c3", "a", "s", CAPSULE, "[]", None)[0] == "conflict"
    assert s.delete("c2") == "conflict" and s.delete("c1") is None and s.delete("c1") == "not_found"


def test_invalid_requests():
    s = CheckpointState()
    for args in (("bad id", "a", "s", CAPSULE, "[]"), ("c", "a", "s", json.dumps({"goal": " ", "summary": "s", "next_action": "n"}), "[]"), ("c", "a", "s", CAPSULE, '[{"revision": 0}]'), ("c", "a", "s", "no", "[]")):
        assert s.save(*args, None)[0] == "invalid"
    assert s.revision == 0


def test_reference_statuses(spark):
    refs = spark.createDataFrame([("n", "a", 1), ("n", "b", 1), ("n", "c", 1), ("x", "a", 1), ("n", "old", 1)], "namespace string, key string, revision long")
    records = spark.createDataFrame([("n", "a", 1, None), ("n", "b", 2, None), ("x", "a", 1, None), ("n", "old", 1, 5)], "namespace string, key string, revision long, expires_at_ms long")
    allowed = spark.createDataFrame([("n",)], "namespace string")
    got = {(r["namespace"], r["key"]): r["status"] for r in checkpoints.reference_status(refs, records, 5, allowed).collect()}
    assert got == {("n", "a"): "available", ("n", "b"): "stale", ("n", "c"): "missing", ("x", "a"): "forbidden", ("n", "old"): "missing"}


def test_fold_latest_and_prunable(spark):
    rows = [("n", i, f"c{i}", "a", f"s{i % 2}", CAPSULE, "[]", None if i < 2 else 2 * (i - 1)) for i in range(4)]
    log = spark.createDataFrame(rows, "namespace string, seq long, id string, agent_id string, session_id string, capsule string, refs string, expected_revision long")
    receipts = checkpoints.fold_checkpoints(log)
    latest = {r["session_id"]: r["id"] for r in checkpoints.latest_checkpoints(receipts).collect()}
    assert latest == {"s0": "c2", "s1": "c3"}
    assert {r["id"] for r in checkpoints.prunable(receipts.select("namespace", "id"), checkpoints.latest_checkpoints(receipts)).collect()} == {"c0", "c1"}
    small = checkpoints.within_budget(receipts.select("id"), 512)
    assert small.where("error_code is not null").count() == 0


def test_status_of_every_reference(spark, sf_dir):
    """The registered query against plain loops over the whole log."""
    log = base.event_log(spark, sf_dir).select("namespace", "key", "revision", "expires_at_ms").collect()
    current = {}
    for r in sorted(log, key=lambda r: r["revision"]):
        current[r["namespace"], r["key"]] = r
    want = []
    for namespace, key, revision, _ in log:
        key += "-gone" if revision % 50 == 0 else ""
        held = current.get((namespace, key))
        if held is not None and held["expires_at_ms"] is not None and held["expires_at_ms"] <= base.NOW_MS:
            held = None
        status = "forbidden" if namespace == "n3" else "missing" if held is None else "available" if held["revision"] == revision else "stale"
        want.append((namespace, key, revision, status))
    got = base.queries()["c02_reference_status"](spark, sf_dir).select("namespace", "key", "revision", "status").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w[3] for w in want} == {"forbidden", "missing", "available", "stale"}


def test_capsules_hold_whole_turns(spark, tmp_path):
    """A turn that starts with 80 spaces is valid, one of over 16 KiB is not."""
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "one"), (1, 3, "assistant", " " * 80 + "two"), (2, 1, "assistant", "x" * 20_000), (3, 1, "assistant", "y" * 16_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    latest = {(r["session_id"], r["id"], r["latest_revision"]) for r in base.c01_latest_checkpoint(spark, str(tmp_path)).collect()}
    assert latest == {("s1", "c1-3", 4), ("s3", "c3-1", 2)}
    assert {r["id"] for r in base.c03_prunable(spark, str(tmp_path)).collect()} == {"c1-1", "c2-1"}
