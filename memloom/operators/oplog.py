"""Operation logs folded to records: put, delete, forget, cleanup, quotas and eviction.

Revisions and quotas belong to a namespace, so a namespace's operations are applied one after
another. The fold streams its sorted log through a state that holds the namespace's records only;
their number is bounded by the namespace's quota, however long the log is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.config import Namespace
from .admission import record_error


@dataclass
class Entry:
    value: bytes
    revision: int
    written_at_ms: int
    expires_at_ms: int | None
    inserted: int


@dataclass
class NamespaceState:
    """Records of one namespace; every method gives (error code, entry, evicted keys)."""

    policy: Namespace
    entries: dict[str, Entry] = field(default_factory=dict)
    bytes: int = 0
    revision: int = 0
    deadlines: list[tuple[int, int, str]] = field(default_factory=list)

    def live(self, key: str, now: int) -> Entry | None:
        e = self.entries.get(key)
        return None if e is None or (e.expires_at_ms is not None and e.expires_at_ms <= now) else e

    @staticmethod
    def condition_holds(condition: str | None, entry: Entry | None) -> bool:
        """any, absent, or a revision number as text."""
        if condition in (None, "", "any"):
            return True
        if condition == "absent":
            return entry is None
        return entry is not None and str(entry.revision) == condition

    def admissible(self, key: str, value: bytes) -> bool:
        p = self.policy
        if not key or len(key.encode()) > p.max_key_bytes or key.startswith("__") or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in key):
            return False
        if len(value) > p.max_value_bytes:
            return False
        try:
            if p.value_kind != "bytes":
                text = value.decode()
                if p.value_kind == "json":
                    json.loads(text)
        except ValueError:
            return False
        return True

    def size(self, key: str, value: bytes) -> int:
        return len(key.encode()) + len(value)

    def _drop(self, key: str) -> None:
        e = self.entries.pop(key)
        self.bytes -= self.size(key, e.value)

    def put(self, key: str, value: bytes, ttl: int | None, condition: str | None, now: int) -> tuple[str | None, Entry | None, list[str]]:
        p = self.policy
        if p.purpose != "records" or not self.admissible(key, value):
            return "invalid", None, []
        ttl, error = p.ttl(ttl)
        if error:
            return error, None, []
        if p.mode == "memory":
            self.cleanup(now, None)
        old, current = self.entries.get(key), self.live(key, now)
        if not self.condition_holds(condition, current):
            return "conflict", None, []
        entries = len(self.entries) + (old is None)
        used = self.bytes - (self.size(key, old.value) if old else 0) + self.size(key, value)
        evicted: list[str] = []
        if p.mode == "memory" and p.on_full == "evict_oldest" and (entries > p.max_entries or used > p.max_total_bytes):
            for victim in sorted((k for k in self.entries if k != key), key=lambda k: self.entries[k].inserted):
                entries -= 1
                used -= self.size(victim, self.entries[victim].value)
                evicted.append(victim)
                if entries <= p.max_entries and used <= p.max_total_bytes:
                    break
        if entries > p.max_entries or used > p.max_total_bytes:
            return "quota", None, []
        for victim in evicted:
            self._drop(victim)
        self.revision += 1
        expires = None if ttl is None else now + ttl * 1000
        entry = Entry(value, self.revision, now, expires, current.inserted if current else self.revision)
        self.entries[key], self.bytes = entry, used
        if expires is not None:
            heapq.heappush(self.deadlines, (expires, entry.revision, key))
        return None, entry, evicted

    def delete(self, key: str, condition: str | None, now: int) -> tuple[str | None, Entry | None, list[str]]:
        current = self.live(key, now)
        if current is None:
            return "not_found", None, []
        if not self.condition_holds(condition, current):
            return "conflict", None, []
        self._drop(key)
        return None, current, []

    def cleanup(self, now: int, batch: int | None) -> int:
        """Removes expired records by (deadline, revision), at most `batch`; their number."""
        n = 0
        while self.deadlines and self.deadlines[0][0] <= now and (batch is None or n < batch):
            _, revision, key = heapq.heappop(self.deadlines)
            e = self.entries.get(key)
            if e is not None and e.revision == revision:
                self._drop(key)
                n += 1
        return n


OUTCOME = "namespace string, seq long, key string, op string, error_code string, revision long, evicted array<string>, entries long, bytes long"
RECORD = "namespace string, key string, value binary, revision long, written_at_ms long, expires_at_ms long, inserted long"


def _apply(state: NamespaceState, row) -> tuple[str | None, int | None, list[str]]:
    value = b"" if row.value is None else bytes(row.value)
    ttl = None if pd.isna(row.ttl_seconds) else int(row.ttl_seconds)
    if row.op == "put":
        error, entry, evicted = state.put(row.key, value, ttl, row.condition, int(row.now_ms))
    elif row.op in ("delete", "forget"):
        error, entry, evicted = state.delete(row.key, row.condition, int(row.now_ms))
    elif row.op == "cleanup":
        return None, state.cleanup(int(row.now_ms), ttl), []
    else:
        return "invalid", None, []
    return error, None if entry is None else entry.revision, evicted


def _fold(policy: Namespace, outcomes: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name, out = None, None, []

        def records():
            for key, e in state.entries.items():
                yield (name, key, e.value, e.revision, e.written_at_ms, e.expires_at_ms, e.inserted)

        columns = [c.split()[0] for c in (OUTCOME if outcomes else RECORD).split(", ")]

        def frame(rows):
            return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("revision", "expires_at_ms") if c in columns})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.namespace != name or state is None:
                    if state is not None and not outcomes:
                        out += records()
                    state, name = NamespaceState(policy), row.namespace
                error, revision, evicted = _apply(state, row)
                if outcomes:
                    out.append((name, int(row.seq), row.key, row.op, error, revision, evicted, len(state.entries), state.bytes))
                if len(out) >= 10_000:
                    yield frame(out)
                    out = []
        if state is not None and not outcomes:
            out += records()
        if out:
            yield frame(out)

    return run


def _sorted(ops: DataFrame) -> DataFrame:
    """All operations of a namespace in one partition, in order; the fold itself streams them."""
    return ops.select("namespace", "seq", "key", "op", "value", "ttl_seconds", "condition", "now_ms").repartition("namespace").sortWithinPartitions("namespace", "seq")


def plain_records(ops: DataFrame, policy: Namespace, block: int = 1 << 20) -> DataFrame:
    """The records that a log of unconditional puts and deletes without TTL leaves, where no quota can
    bind: nothing depends on order but the revisions, and these are counts of the puts before.

    They are counted in blocks of `block` sequence numbers, and the blocks' sums added up, so that a
    namespace of any size is dealt over all tasks.
    """
    valid = record_error(F.col("key"), F.col("value"), policy.value_kind, policy.max_key_bytes, policy.max_value_bytes).isNull()
    puts = ops.where((F.col("op") == "put") & valid).withColumn("block", F.floor(F.col("seq") / block))
    blocks = puts.groupBy("namespace", "block").agg(F.count("*").alias("n"))
    before = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("namespace").orderBy("block")) - F.col("n")).drop("n")
    inner = F.row_number().over(Window.partitionBy("namespace", "block").orderBy("seq"))
    numbered = puts.withColumn("inner", inner).join(before, ["namespace", "block"])
    put = numbered.select("namespace", "key", "seq", "value", (F.col("before") + F.col("inner")).alias("revision"), F.col("now_ms").alias("written_at_ms"))
    gone = ops.where(F.col("op").isin("delete", "forget")).groupBy("namespace", "key").agg(F.max("seq").alias("gone"))
    # a record counts as inserted when it was first put behind its last delete
    kept = put.join(gone, ["namespace", "key"], "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    newest = kept.groupBy("namespace", "key").agg(F.max_by(F.struct("value", "revision", "written_at_ms"), "seq").alias("r"), F.min("revision").alias("inserted"))
    return newest.select("namespace", "key", "r.value", "r.revision", "r.written_at_ms", F.lit(None).cast("long").alias("expires_at_ms"), "inserted")


def fold_outcomes(ops: DataFrame, policy: Namespace) -> DataFrame:
    """One row per operation: its error code or revision, what it evicted, and the usage behind it."""
    return _sorted(ops).mapInPandas(_fold(policy, True), OUTCOME)


def fold_records(ops: DataFrame, policy: Namespace) -> DataFrame:
    """The records that are left when all operations are applied."""
    return _sorted(ops).mapInPandas(_fold(policy, False), RECORD)
