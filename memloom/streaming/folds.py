"""Streaming forms of the folds: slots, live records and latest pointers.

Late events are a matter of event time within a slot's state, not of a watermark: they are kept as
history. Batches are applied at most once by their id, so a restart repeats nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.ledger import ADMISSION, Sliding
from ..operators.lifecycle import RECEIPTS, Slot, _frame, step

_STATE = "body string"


def lifecycle_stream(proposals: DataFrame) -> DataFrame:
    """Receipts of a stream of proposals; each slot's state is kept as JSON between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot = Slot(**json.loads(state.get[0])) if state.exists else Slot(key[1], key[2])
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for row in rows.itertuples(index=False):
            slot, status, replayed = step(slot, row)
            out.append((*key, int(row.seq), status, replayed, slot.revision, slot.state))
        state.update((json.dumps(asdict(slot), ensure_ascii=False),))
        yield _frame(out, RECEIPTS)

    grouped = proposals.groupBy("scope", "entity", "attribute")
    return grouped.applyInPandasWithState(run, RECEIPTS, _STATE, "append", "NoTimeout")


def admission_stream(events: DataFrame, seconds: int, most: int, units: int) -> DataFrame:
    """Sliding admission over a stream; an account's state is what it admitted within the window."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admit = Sliding(seconds, most, units, [(a, n) for a, n in json.loads(state.get[0])] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [admit(row) for row in rows.itertuples(index=False)]
        state.update((json.dumps([(float(a), int(n)) for a, n in admit.held]),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ADMISSION.split(", ")])

    grouped = events.select("account", "seq", "at", "units").groupBy("account")
    return grouped.applyInPandasWithState(run, ADMISSION, _STATE, "append", "NoTimeout")


def expiring_counts(events: DataFrame, event_time: str, window: str, delay: str, *by: str) -> DataFrame:
    """Counts per window and key with bounded state: an extension for event streams."""
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, window), *by).agg(F.count("*").alias("n"))


def latest_pointers(receipts: DataFrame) -> DataFrame:
    """Newest checkpoint of each session in a stream of receipts (complete or update mode)."""
    ok = receipts.where(F.col("error_code").isNull() & F.col("is_latest"))
    return ok.groupBy("namespace", "agent_id", "session_id").agg(F.max_by("id", "latest_revision").alias("id"), F.max("latest_revision").alias("latest_revision"))


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch under its own id; a batch that is repeated after a failure replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_expired(records: DataFrame, now_ms: int) -> DataFrame:
    """Per batch: what a scheduled cleanup keeps."""
    return records.where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))
