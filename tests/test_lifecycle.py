import os

from memloom import queries as base
from memloom.operators import lifecycle
from memloom.operators.lifecycle import Slot, apply_proposal, forget
from memloom.streaming.folds import lifecycle_stream


def observed(i, at, value, operation="assert", expected=None):
    p = {"entity": "ann", "attribute": "city", "value": value, "kind": "fact", "operation": operation, "source": {"id": f"s{i}", "text": "t", "role": "user", "occurred_at_ms": at}, "valid_until_ms": None}
    return p | ({"expected_revision": expected} if operation == "correct" else {})


def test_every_outcome_in_order():
    slot = Slot("ann", "city")
    slot, status, _ = apply_proposal(slot, observed(1, 10, "Rome"))
    assert status == "created"
    slot, status, replayed = apply_proposal(slot, observed(1, 10, "Rome"))
    assert (status, replayed, slot.revision) == ("created", True, 1)
    assert apply_proposal(slot, observed(1, 10, "Oslo"))[1] == "source_reuse"
    slot, status, _ = apply_proposal(slot, observed(2, 5, "Bern"))
    assert status == "stale" and slot.current["value"] == "Rome"
    slot, status, _ = apply_proposal(slot, observed(3, 20, "Rome"))
    assert status == "duplicate" and slot.last_confirmed_at_ms == 20
    slot, status, _ = apply_proposal(slot, observed(4, 30, "Oslo"))
    assert status == "conflict" and slot.state == "conflicted" and slot.content() == "Unresolved memory."
    assert apply_proposal(slot, observed(5, 40, "Oslo", "correct", 1))[1] == "revision_conflict"
    assert apply_proposal(slot, observed(5, 25, "Oslo", "correct", slot.revision))[1] == "older_correction"
    slot, status, _ = apply_proposal(slot, observed(5, 40, "Oslo", "correct", slot.revision))
    assert status == "corrected" and slot.state == "active" and not slot.conflicts and len(slot.history) == 3
    revision = slot.revision
    slot, status, _ = forget(slot, revision)
    assert status == "forgotten" and slot.current is None
    assert forget(slot, revision)[2] and apply_proposal(slot, observed(9, 99, "Rome"))[1] == "forgotten"


def test_conflicts_leave_room_for_their_resolution():
    slot, status, _ = apply_proposal(Slot("ann", "city"), observed(0, 1, "v"))
    statuses = []
    for i in range(1, 10):
        slot, status, _ = apply_proposal(slot, observed(i, 10 + i, f"v{i}"))
        statuses.append(status)
    assert statuses == ["conflict"] * 7 + ["capacity"] * 2


def rows():
    out = []
    for i, (at, value) in enumerate(((10, "a"), (5, "b"), (20, "a"), (30, "c"))):
        out.append(("me", "ann", "city", i, "assert", value, "fact", f"s{i}", "t", "user", at, None, None))
    return out


SCHEMA = "scope string, entity string, attribute string, seq long, operation string, value string, kind string, source_id string, source_text string, source_role string, occurred_at_ms long, valid_until_ms long, expected_revision long"


def test_folds(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert [r["status"] for r in lifecycle.fold_receipts(df).orderBy("seq").collect()] == ["created", "stale", "duplicate", "conflict"]
    slot = lifecycle.fold_slots(df).first()
    assert (slot["state"], slot["history"], slot["conflicts"], slot["revision"]) == ("conflicted", 1, 1, 4)
    assert lifecycle.profile(lifecycle.fold_slots(df), 0).count() == 0


def test_batches_are_validated_first(spark):
    bad = [("me", "ann", "city", 9, "assert", "x", "fact", "s9", "t", "assistant", 40, None, None), ("me", " ", "city", 10, "assert", "x", "fact", "s10", "t", "user", 40, None, None)]
    got = [r["status"] for r in lifecycle.apply_batch(spark.createDataFrame(rows() + bad, SCHEMA)).orderBy("seq").collect()]
    assert got == ["created", "stale", "duplicate", "conflict", "invalid_role", "missing_field"]


def test_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((rows()[:2], rows()[2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle_stream(stream).writeStream.format("memory").queryName("receipts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r["status"] for r in spark.sql("select * from receipts order by seq").collect()]
    assert got == ["created", "stale", "duplicate", "conflict"]


def test_receipts_of_every_proposal(spark, sf_dir):
    """The registered query against plain loops over all proposals of each slot, which the events'
    short texts fill by number before they do by bytes."""
    slots, want = {}, []
    for r in sorted(base.proposals(spark, sf_dir).collect(), key=lambda r: r["seq"]):
        key = (r["entity"], r["attribute"])
        s = slots.setdefault(key, {"value": None, "confirmed": 0, "taken": 0, "stale": 0, "conflict": 0})
        at = r["occurred_at_ms"]
        status = "created" if s["value"] is None else "stale" if at < s["confirmed"] else "duplicate" if r["value"] == s["value"] else "conflict"
        after = s | {"taken": s["taken"] + 1} | ({status: s[status] + 1} if status in ("stale", "conflict") else {"value": r["value"], "confirmed": at})
        open_ = after["conflict"] > 0  # then a correction must still fit
        if after["stale"] > 8 or after["taken"] + open_ > 24 or (open_ and after["stale"] + 1 + after["conflict"] > 8):
            status = "capacity"
        else:
            slots[key] = s = after
        want.append((*key, r["seq"], status, False, s["taken"], "conflicted" if s["conflict"] else "active"))
    got = base.l01_receipts(spark, sf_dir).select("entity", "attribute", "seq", "status", "replayed", "revision", "state").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {w[3] for w in want} == {"created", "stale", "duplicate", "conflict", "capacity"}
