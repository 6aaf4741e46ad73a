"""Reads over folded records: point and prefix scans, usage, latest revisions, expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import live

INFO = ("key", "revision", "bytes", "expires_at_ms")


def get(records: DataFrame, namespace: str, key: str, now_ms: int) -> DataFrame:
    return records.where((F.col("namespace") == namespace) & (F.col("key") == key) & live(F.col("expires_at_ms"), now_ms))


def info(records: DataFrame) -> DataFrame:
    return records.select("key", "revision", F.octet_length("value").cast("long").alias("bytes"), "expires_at_ms")


def list_page(records: DataFrame, namespace: str, prefix: str, now_ms: int, after: str | None = None, limit: int = 100) -> DataFrame:
    """Live records of a prefix by key, behind `after`; the filters reach the scan."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1..1000")
    rows = records.where((F.col("namespace") == namespace) & F.col("key").startswith(prefix) & live(F.col("expires_at_ms"), now_ms))
    if after is not None:
        rows = rows.where(F.col("key") > after)
    return info(rows).orderBy("key").limit(limit)


def latest(log: DataFrame) -> DataFrame:
    """Newest row per namespace and key: a partial aggregate, not a window over each key's history."""
    rest = [c for c in log.columns if c not in ("namespace", "key")]
    newest = F.max_by(F.struct(*rest), "revision")
    return log.groupBy("namespace", "key").agg(newest.alias("r")).select("namespace", "key", "r.*")


def visible_at(log: DataFrame, at_ms: int) -> DataFrame:
    """What a reader saw at a time: the newest version written by then, unless it had expired."""
    return latest(log.where(F.col("written_at_ms") <= at_ms)).where(live(F.col("expires_at_ms"), at_ms))


def usage(records: DataFrame) -> DataFrame:
    """Entries and bytes of each namespace; the revision is that of the log, not of what survives."""
    size = F.octet_length("key") + F.octet_length("value")
    return records.groupBy("namespace").agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def expired_batch(records: DataFrame, now_ms: int, batch: int) -> DataFrame:
    """What one cleanup removes: expired records by deadline and revision."""
    return records.where(~live(F.col("expires_at_ms"), now_ms)).orderBy("expires_at_ms", "revision", "namespace", "key").limit(batch)


def compacted(records: DataFrame, now_ms: int) -> DataFrame:
    return records.where(live(F.col("expires_at_ms"), now_ms))


def fifo_kept(records: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """What oldest-first eviction leaves of each namespace: the newest whose running totals fit.

    The count is cut by rank first, which every task does with its own rows before they move; the sum
    then runs over `max_entries` rows a namespace.
    """
    newest = Window.partitionBy("namespace").orderBy(F.desc("inserted"))
    size = F.octet_length("key") + F.octet_length("value")
    few = records.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= max_entries)
    used = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("used", used).where(F.col("used") <= max_bytes).drop("n", "used")


def undeclared(persisted: DataFrame, declared: DataFrame) -> DataFrame:
    """Namespaces with records whose policy is gone or has another mode or purpose."""
    return persisted.join(declared, ["namespace", "mode", "purpose"], "left_anti")


def allowed(grants: DataFrame, principal: str, operation: str) -> DataFrame:
    return grants.where((F.col("principal") == principal) & (F.col("operation") == operation)).select("namespace").distinct()


def authorised(records: DataFrame, grants: DataFrame, principal: str, operation: str = "get") -> DataFrame:
    return records.join(allowed(grants, principal, operation), "namespace", "left_semi")
