"""One handle over a policy, an operation log and the tables folded from it."""

from __future__ import annotations

import json
import unicodedata
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checkpoints, oplog, records
from .plans import cursor as cursors
from .plans.search import Filters, SearchQuery, recall, recall_candidates, search
from .plans.stored import SearchIndex
from .sources.config import Policy


class EngineError(Exception):
    """code: invalid, namespace_not_found, not_found, forbidden, conflict or quota."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail or code)
        self.code = code


class Engine:
    """Operations append to a log; reads are lazy DataFrames over its fold at `now_ms`.

    `log` has namespace, seq, key, op, value, ttl_seconds, condition and now_ms. Memories are JSON
    records with the marker field MEMORY.
    """

    MEMORY = "memloom_memory"

    LOG = "namespace string, seq long, key string, op string, value binary, ttl_seconds long, condition string, now_ms long"
    SAVES = "namespace string, seq long, id string, agent_id string, session_id string, capsule string, refs string, expected_revision long"

    def __init__(self, spark: SparkSession, policy: Policy, log: DataFrame | None = None, now_ms: int = 0, principal: str | None = None, saves: DataFrame | None = None, added: tuple = (), pruned: tuple = ()):
        self.spark, self.policy, self.now_ms, self.principal = spark, policy.validate(), now_ms, principal
        self.base = spark.createDataFrame([], self.LOG) if log is None else log
        self.saves = spark.createDataFrame([], self.SAVES) if saves is None else saves
        # operations since the base; one relation, however many they are, so that plans do not grow
        self.added, self.pruned = added, pruned

    @classmethod
    def open(cls, spark: SparkSession, policy: Policy, log: DataFrame, persisted: DataFrame, **more) -> Engine:
        """A handle over a stored log; `persisted` has (namespace, mode, purpose) of what was declared when
        it was written. A namespace that the policy dropped or gave another mode or purpose is refused."""
        schema = "namespace string, mode string, purpose string"
        if set(persisted.columns) != {"namespace", "mode", "purpose"}:
            raise EngineError("invalid", "the catalog has another format")
        declared = spark.createDataFrame([(n.name, n.mode, n.purpose) for n in policy.namespaces], schema)
        if lost := records.undeclared(persisted, declared).orderBy("namespace").limit(10).collect():
            raise EngineError("invalid", f"removed or changed: {[r['namespace'] for r in lost]}")
        return cls(spark, policy, log, **more)

    @property
    def log(self) -> DataFrame:
        return self.base.unionByName(self.spark.createDataFrame(list(self.added), self.base.schema)) if self.added else self.base

    def stored(self, path: str) -> Engine:
        """Writes the log as a table and goes on from there."""
        self.log.write.mode("error").parquet(path)
        return self._with(base=self.spark.read.schema(self.base.schema).parquet(path), added=())

    def _with(self, **changed) -> Engine:
        held = {"base": self.base, "now_ms": self.now_ms, "principal": self.principal, "saves": self.saves, "added": self.added, "pruned": self.pruned} | changed
        return Engine(self.spark, self.policy, held.pop("base"), **held)

    def at(self, now_ms: int) -> Engine:
        return self._with(now_ms=now_ms)

    def _namespace(self, name: str, operation: str):
        ns = self.policy.namespace(name)
        if ns is None:
            raise EngineError("namespace_not_found", name)
        if self.principal is not None and (self.principal, name, operation) not in self.policy.grants:
            raise EngineError("forbidden", f"{operation} on {name}")
        return ns

    def append(self, rows: list[tuple]) -> Engine:
        """A handle behind more operations (namespace, seq, key, op, value, ttl_seconds, condition, now_ms)."""
        return self._with(added=(*self.added, *rows))

    def _apply(self, namespace: str, grant: str, key: str, op: str, value: bytes | None = None, ttl: int | None = None, condition: str = "any") -> tuple[Engine, dict]:
        """The engine behind one more operation, and its outcome; an error leaves this one as it is."""
        self._namespace(namespace, grant)
        last = self.log.where(F.col("namespace") == namespace).agg(F.max("seq")).first()[0]
        seq = 0 if last is None else last + 1
        after = self.append([(namespace, seq, key, op, value, ttl, condition, self.now_ms)])
        row = after.outcomes(namespace, grant).where(F.col("seq") == seq).first()
        if row["error_code"]:
            raise EngineError(row["error_code"], key)
        return after, row.asDict()

    def put(self, namespace: str, key: str, value: bytes, ttl_seconds: int | None = None, condition: str = "any") -> tuple[Engine, dict]:
        """Condition: any, absent, or the live record's revision."""
        return self._apply(namespace, "put", key, "put", value, ttl_seconds, condition)

    def delete(self, namespace: str, key: str, condition: str = "any") -> tuple[Engine, dict]:
        return self._apply(namespace, "delete", key, "delete", condition=condition)

    def remember(self, namespace: str, key: str | None, content: str, topic: str, tags: list[str] | None = None, metadata: dict | None = None, occurred_at_ms: int | None = None, ttl_seconds: int | None = None, condition: str = "absent") -> tuple[Engine, dict]:
        """Keeps a memory; new by default, under a random key if none is given. Durable JSON namespaces only."""
        key = key or str(uuid.uuid4())
        ns = self._namespace(namespace, "put")
        value = self.envelope(content, topic, tags, metadata, occurred_at_ms)
        labels = [topic, *(tags or [])]
        fits = 0 < len(content.encode()) <= 16_384 and len(tags or []) <= 8 and len(key.encode()) <= 256 and len(json.dumps(metadata or {}, ensure_ascii=False).encode()) <= 8_192
        named = all(0 < len(t.strip().lower().encode()) <= 64 and not any(unicodedata.category(c) == "Cc" for c in t.strip()) for t in labels)
        if not fits or not named or ns.mode != "durable" or ns.value_kind != "json":
            raise EngineError("invalid", key)
        return self.put(namespace, key, value, ttl_seconds, condition)

    def forget(self, namespace: str, key: str, condition: str = "any") -> tuple[Engine, dict]:
        """Deletes a memory; a raw record of that key is not found."""
        self._namespace(namespace, "delete")
        own = self._with(principal=None)
        own.memory_get(namespace, key)
        return self.delete(namespace, key, condition)

    def cleanup(self, namespace: str) -> tuple[Engine, int]:
        """Removes expired records, a batch of the policy's size at most; their number."""
        after, row = self._apply(namespace, "delete", "", "cleanup", ttl=self.policy.limits.cleanup_batch)
        return after, row["revision"]

    def outcomes(self, namespace: str, operation: str = "stats") -> DataFrame:
        ns = self._namespace(namespace, operation)
        return oplog.fold_outcomes(self.log.where(F.col("namespace") == namespace), ns)

    def records(self, namespace: str, operation: str = "get") -> DataFrame:
        ns = self._namespace(namespace, operation)
        return oplog.fold_records(self.log.where(F.col("namespace") == namespace), ns)

    def get(self, namespace: str, key: str) -> dict:
        row = records.get(self.records(namespace), namespace, key, self.now_ms).first()
        if row is None:
            raise EngineError("not_found", key)
        return row.asDict()

    def list(self, namespace: str, prefix: str = "", cursor: str | None = None, limit: int = 100) -> tuple[list[dict], str | None]:
        bound = cursors.binding("list", namespace, prefix)
        after = cursors.decode(cursor, bound)[0] if cursor else None
        rows = [r.asDict() for r in records.list_page(self.records(namespace, "list"), namespace, prefix, self.now_ms, after, limit).collect()]
        return rows, cursors.encode([rows[-1]["key"]], bound) if len(rows) == limit else None

    def usage(self, namespace: str) -> dict:
        row = self.outcomes(namespace).orderBy(F.desc("seq")).first()
        high = self.outcomes(namespace).where(F.col("op") == "put").agg(F.max("revision")).first()[0]
        return {"namespace": namespace, "entries": row["entries"] if row else 0, "bytes": row["bytes"] if row else 0, "revision": high or 0}

    def memories(self, namespace: str) -> DataFrame:
        """Structured records as columns."""
        schema = f"{self.MEMORY} int, content string, topic string, tags array<string>, metadata string, occurred_at_ms long"
        parsed = self.records(namespace, "list").withColumn("m", F.from_json(F.col("value").cast("string"), schema))
        return parsed.where(F.col(f"m.{self.MEMORY}").isNotNull()).select(
            "namespace", "key", "m.content", "m.topic", "m.tags", "m.metadata", F.coalesce("m.occurred_at_ms", "written_at_ms").alias("occurred_at_ms"),
            "revision", "written_at_ms", "expires_at_ms",
        )

    @classmethod
    def envelope(cls, content: str, topic: str, tags: list[str] | None = None, metadata: dict | None = None, occurred_at_ms: int | None = None) -> bytes:
        """Value of a put that remembers a memory."""
        body = {cls.MEMORY: 1, "content": content, "topic": topic.strip().lower(), "tags": sorted({t.strip().lower() for t in tags or []}), "occurred_at_ms": occurred_at_ms}
        if metadata is not None:
            body["metadata"] = json.dumps(metadata, ensure_ascii=False)
        return json.dumps(body, ensure_ascii=False).encode()

    def memory_get(self, namespace: str, key: str) -> dict:
        row = records.get(self.memories(namespace), namespace, key, self.now_ms).first()
        if row is None:
            raise EngineError("not_found", key)
        return row.asDict()

    def generation(self, namespace: str) -> int:
        """Applied writes of a namespace; a ranked cursor holds for one generation."""
        return self.outcomes(namespace).where(F.col("error_code").isNull()).count()

    def index(self, namespace: str, path: str) -> SearchIndex:
        """A stored index of the namespace's memories as they are now."""
        return SearchIndex.build(self.memories(namespace), path)

    def _page_bytes(self, max_bytes: int | None) -> int:
        if max_bytes is None:
            return min(16_384, self.policy.limits.max_result_bytes)
        if not 1024 <= max_bytes <= self.policy.limits.max_result_bytes:
            raise EngineError("invalid", f"max_bytes must be 1024..{self.policy.limits.max_result_bytes}")
        return max_bytes

    def recall(self, namespace: str, filters: Filters = Filters(), query: str = "", limit: int = 20, cursor: str | None = None, max_bytes: int | None = None, bounded: bool = False) -> tuple[list[dict], str | None]:
        """A page by event time within `max_bytes`. A bounded one looks at the policy's number of candidates
        at most; it may be empty and still have a cursor."""
        self._namespace(namespace, "get")  # besides list
        bound = cursors.binding("recall", namespace, repr(filters), query)
        after = tuple(cursors.decode(cursor, bound)) if cursor else None
        position = lambda r: cursors.encode([r["occurred_at_ms"], r["key"]], bound)
        if not bounded:
            rows = [r.asDict() for r in recall(self.memories(namespace), self.now_ms, filters, query, limit, after, ahead=1).collect()]
            return cursors.fit_page(rows, limit, self._page_bytes(max_bytes), position)
        most = self.policy.limits.max_candidates
        hits, last = recall_candidates(self.memories(namespace), self.now_ms, filters, query, most, after)
        rows = [r.asDict() for r in hits.orderBy(F.desc("occurred_at_ms"), F.desc("key")).limit(limit + 1).collect()]
        page, following = cursors.fit_page(rows, limit, self._page_bytes(max_bytes), position)
        if following is None and (end := last.first()) is not None:
            rest = recall(self.memories(namespace), self.now_ms, filters, "", 1, (end["occurred_at_ms"], end["key"]))
            following = None if rest.isEmpty() else position(end)
        return page, following

    def search(self, namespace: str, query: SearchQuery, cursor: str | None = None, max_bytes: int | None = None, index: SearchIndex | None = None) -> tuple[list[dict], str | None]:
        """A page by score within `max_bytes`; a cursor from before a write is refused. With a stored index
        only the postings of the query's terms are read."""
        self._namespace(namespace, "get")  # besides list
        state = self._with(principal=None).generation(namespace) if index is None else index.generation
        bound = cursors.binding("search", namespace, query.text, repr(query.filters), query.expansion_terms, query.expand, query.stemmed, state)
        if cursor:
            bits, key = cursors.decode(cursor, bound)
            query = replace(query, after=(cursors.bits_score(bits), key))
        memories = self.memories(namespace)
        hits = search(memories, query, self.now_ms, ahead=1) if index is None else index.search(memories, query, self.now_ms, ahead=1)
        rows = [r.asDict() for r in hits.collect()]
        return cursors.fit_page(rows, query.limit, self._page_bytes(max_bytes), lambda r: cursors.encode([cursors.score_bits(r["score"]), r["key"]], bound))

    def receipts(self, namespace: str, operation: str = "get") -> DataFrame:
        self._namespace(namespace, operation)
        return checkpoints.fold_checkpoints(self.saves.where(F.col("namespace") == namespace))

    def checkpoint(self, namespace: str, id: str, agent: str, session: str, capsule: dict, references: list[dict] = (), expected_revision: int | None = None) -> tuple[Engine, dict]:
        """Saves a bundle and moves the session's pointer, both or neither."""
        if self._namespace(namespace, "put").purpose != "checkpoints":
            raise EngineError("invalid", namespace)
        for ref in references:
            self._namespace(ref["namespace"], "get")
        last = self.saves.where(F.col("namespace") == namespace).agg(F.max("seq")).first()[0]
        seq = 0 if last is None else last + 1
        row = (namespace, seq, id, agent, session, json.dumps(capsule, ensure_ascii=False), json.dumps(list(references)), expected_revision)
        after = self._with(saves=self.saves.unionByName(self.spark.createDataFrame([row], self.SAVES)))
        receipt = after.receipts(namespace, "put").where(F.col("seq") == seq).first()
        if receipt["error_code"]:
            raise EngineError(receipt["error_code"], id)
        return after, receipt.asDict()

    def delete_checkpoint(self, namespace: str, id: str) -> Engine:
        """Drops a bundle; a session's latest one stays."""
        self._namespace(namespace, "delete")
        own = self.receipts(namespace, "delete").where(F.col("error_code").isNull())
        if (namespace, id) in self.pruned or own.where(F.col("id") == id).isEmpty():
            raise EngineError("not_found", id)
        if checkpoints.prunable(own.where(F.col("id") == id).select("namespace", "id"), checkpoints.latest_checkpoints(own)).isEmpty():
            raise EngineError("conflict", id)
        return self._with(pruned=(*self.pruned, (namespace, id)))

    def restore_latest(self, namespace: str, agent: str, session: str, budget: int = 32_768) -> dict:
        own = self.receipts(namespace).where((F.col("agent_id") == agent) & (F.col("session_id") == session))
        head = checkpoints.latest_checkpoints(own).first()
        if head is None:
            raise EngineError("not_found", f"{agent}/{session}")
        return self.restore(namespace, head["id"], budget)

    def restore(self, namespace: str, id: str, budget: int = 32_768) -> dict:
        """A checkpoint with its references resolved, or an error, never a part."""
        if not checkpoints.RESTORE_BUDGET[0] <= budget <= checkpoints.RESTORE_BUDGET[1]:
            raise EngineError("invalid", "restore budget must be 512..1048576 bytes")
        saved = self.receipts(namespace).where((F.col("id") == id) & F.col("error_code").isNull()).orderBy("seq").first()
        if saved is None or (namespace, id) in self.pruned:
            raise EngineError("not_found", id)
        bundle = self.saves.where((F.col("namespace") == namespace) & (F.col("seq") == saved["seq"])).first()
        pointer = checkpoints.latest_checkpoints(self.receipts(namespace)).where((F.col("agent_id") == saved["agent_id"]) & (F.col("session_id") == saved["session_id"])).first()
        out = {"checkpoint_id": id, "revision": saved["revision"], "latest_revision": pointer["latest_revision"], "capsule": json.loads(bundle["capsule"]), "references": []}
        for ref in json.loads(bundle["refs"] or "[]"):
            out["references"].append({**ref, "status": self._status(ref)})
        if len(json.dumps(out, ensure_ascii=False).encode()) > budget:
            raise EngineError("invalid", "restore exceeds its byte budget")
        return out

    def _status(self, ref: dict) -> str:
        try:
            return "available" if self.get(ref["namespace"], ref["key"])["revision"] == ref["revision"] else "stale"
        except EngineError as error:
            return "forbidden" if error.code == "forbidden" else "missing"
