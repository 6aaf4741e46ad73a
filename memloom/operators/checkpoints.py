"""Checkpoints: an ordered log folded to bundles and latest pointers, and restores with references."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import live

SCHEME = "memloom"
MAX_CAPSULE_BYTES, MAX_REFERENCES = 16_384, 64
RESTORE_BUDGET = (512, 1 << 20)
_ID = re.compile(r"[A-Za-z0-9_-]{1,64}")
RECEIPT = (
    "namespace string, seq long, id string, agent_id string, session_id string, error_code string, revision long, "
    "latest_revision long, locator string, is_latest boolean"
)


def capsule_json(capsule: dict) -> str:
    return json.dumps(capsule, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class CheckpointState:
    """Bundles and pointers of one namespace, applied in order."""

    def __init__(self):
        self.revision = 0
        self.bundles: dict[str, tuple[str, int, str, str]] = {}  # id: payload, revision, agent, session
        self.latest: dict[tuple[str, str], tuple[str, int]] = {}  # agent and session: id, pointer revision

    def save(self, id: str, agent: str, session: str, capsule: str, references: str, expected: int | None) -> tuple[str | None, int | None, int | None, bool | None]:
        """Error code, bundle revision, pointer revision, whether it is the latest."""
        if not all(isinstance(x, str) and _ID.fullmatch(x) for x in (id, agent, session)):
            return "invalid", None, None, None
        try:
            body, refs = json.loads(capsule), json.loads(references or "[]")
        except (TypeError, ValueError):
            return "invalid", None, None, None
        if any(not str(body.get(f) or "").strip() for f in ("goal", "summary", "next_action")):
            return "invalid", None, None, None
        if len(capsule_json(body).encode()) > MAX_CAPSULE_BYTES or len(refs) > MAX_REFERENCES or any(int(r.get("revision") or 0) <= 0 for r in refs):
            return "invalid", None, None, None
        payload = capsule_json({"agent": agent, "session": session, "capsule": body, "references": refs, "expected": expected})
        pointer = self.latest.get((agent, session))
        if id in self.bundles:  # the same request again gives its receipt and moves nothing
            old, revision, *_ = self.bundles[id]
            if old != payload:
                return "conflict", None, None, None
            return None, revision, pointer[1], pointer[0] == id
        if (pointer is None) != (expected is None) or (pointer is not None and pointer[1] != expected):
            return "conflict", None, None, None
        self.bundles[id] = (payload, self.revision + 1, agent, session)
        self.latest[agent, session] = (id, self.revision + 2)
        self.revision += 2
        return None, self.revision - 1, self.revision, True

    def delete(self, id: str) -> str | None:
        if id not in self.bundles:
            return "not_found"
        _, _, agent, session = self.bundles[id]
        if self.latest.get((agent, session), ("",))[0] == id:
            return "conflict"
        del self.bundles[id]
        return None


def fold_checkpoints(log: DataFrame) -> DataFrame:
    """Receipts of a log (namespace, seq, id, agent_id, session_id, capsule, refs, expected_revision)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name = CheckpointState(), None
        columns = [c.split()[0] for c in RECEIPT.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.namespace != name:
                    state, name = CheckpointState(), r.namespace
                expected = None if pd.isna(r.expected_revision) else int(r.expected_revision)
                error, revision, pointer, latest = state.save(r.id, r.agent_id, r.session_id, r.capsule, r.refs, expected)
                locator = None if error else f"{SCHEME}://{name}/checkpoints/{r.id}"
                out.append((name, int(r.seq), r.id, r.agent_id, r.session_id, error, revision, pointer, locator, latest))
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"revision": "Int64", "latest_revision": "Int64", "is_latest": "boolean"})

    columns = ("namespace", "seq", "id", "agent_id", "session_id", "capsule", "refs", "expected_revision")
    return log.select(*columns).repartition("namespace").sortWithinPartitions("namespace", "seq").mapInPandas(run, RECEIPT)


def latest_checkpoints(receipts: DataFrame) -> DataFrame:
    """The newest successful checkpoint of each session: a partial aggregate."""
    ok = receipts.where(F.col("error_code").isNull() & F.col("is_latest"))
    newest = F.max_by(F.struct("id", "revision", "locator"), "latest_revision").alias("c")
    return ok.groupBy("namespace", "agent_id", "session_id").agg(newest, F.max("latest_revision").alias("latest_revision")).select(
        "namespace", "agent_id", "session_id", "c.*", "latest_revision"
    )


def prunable(bundles: DataFrame, latest: DataFrame) -> DataFrame:
    """Bundles that may be deleted: all but their session's latest."""
    return bundles.join(latest.select("namespace", "id"), ["namespace", "id"], "left_anti")


def reference_status(references: DataFrame, records: DataFrame, now_ms: int, allowed: DataFrame | None = None) -> DataFrame:
    """Adds `status`: forbidden (no grant, tested first), missing, available (same revision) or stale."""
    current = records.where(live(F.col("expires_at_ms"), now_ms)).select("namespace", "key", F.col("revision").alias("current_revision"))
    out = references.join(current, ["namespace", "key"], "left")
    granted = F.lit(True)
    if allowed is not None:
        out = out.join(allowed.select("namespace", F.lit(True).alias("granted")), "namespace", "left")
        granted = F.coalesce("granted", F.lit(False))
    status = (
        F.when(~granted, "forbidden")
        .when(F.col("current_revision").isNull(), "missing")
        .when(F.col("current_revision") == F.col("revision"), "available")
        .otherwise("stale")
    )
    return out.withColumn("status", status).drop("current_revision", "granted")


def within_budget(restored: DataFrame, budget: int) -> DataFrame:
    """Adds `error_code` where a whole restore is over the byte budget; it is never cut."""
    if not RESTORE_BUDGET[0] <= budget <= RESTORE_BUDGET[1]:
        raise ValueError("restore budget must be 512..1048576 bytes")
    size = F.octet_length(F.to_json(F.struct(*restored.columns)))
    return restored.withColumn("error_code", F.when(size > budget, "over_budget"))
