"""Ledgers and snapshots: budgets, sliding admission, counter deltas and trailing windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATE_WINDOW_S, RATE_EVENTS, RATE_UNITS = 61, 400, 150_000
BUDGET = "account string, seq long, id string, admitted boolean, accounted double"
ADMISSION = "account string, seq long, at double, units long, admitted boolean"


def status_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("status").agg(F.count("*").alias("n"), F.sum("charged").alias("charged"), F.sum("reserved").alias("reserved"))


def accounted(calls: DataFrame) -> DataFrame:
    held = F.when(F.col("status") == "reserved", F.col("reserved")).otherwise(F.col("charged"))
    return calls.agg(F.coalesce(F.sum(held), F.lit(0.0)).alias("accounted"))


def trailing(events: DataFrame, seconds: int = RATE_WINDOW_S) -> DataFrame:
    """Events and units in the trailing window of each event (account, at in seconds, units).

    Time is cut into slots of a window's length; an event counts in its own slot and is shown to the
    next one, so that a task holds two slots of an account and not all of it.
    """
    slot = F.floor(F.col("at") / seconds)
    dealt = events.withColumn("slot_", F.explode(F.array(slot, slot + 1)))
    window = Window.partitionBy("account", "slot_").orderBy("at").rangeBetween(-seconds, 0)
    counted = dealt.withColumns({"n": F.count("*").over(window), "total": F.sum("units").over(window)})
    return counted.where(F.col("slot_") == slot).drop("slot_")


def _streamed(rows: DataFrame, fold, schema: str) -> DataFrame:
    """An ordered fold per account over a sorted stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, name = None, None
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.account != name or state is None:
                    state, name = fold(), row.account
                out.append(state(row))
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition("account").sortWithinPartitions("account", "seq").mapInPandas(run, schema)


def admit(events: DataFrame, seconds: int = RATE_WINDOW_S, most: int = RATE_EVENTS, units: int = RATE_UNITS) -> DataFrame:
    """Sliding admission: an event enters if those admitted in the window leave room for it."""

    return _streamed(events.select("account", "seq", "at", "units"), lambda: Sliding(seconds, most, units), ADMISSION)


class Sliding:
    """Events admitted within the trailing window; at most `most` are held."""

    def __init__(self, seconds: int, most: int, units: int, held: Iterable[tuple[float, int]] = ()):
        self.seconds, self.most, self.units = seconds, most, units
        self.held = deque((at, n) for at, n in held)
        self.total = sum(n for _, n in self.held)

    def __call__(self, row) -> tuple:
        while self.held and self.held[0][0] < row.at - self.seconds:
            self.total -= self.held.popleft()[1]
        ok = len(self.held) < self.most and self.total + row.units <= self.units
        if ok:
            self.held.append((row.at, row.units))
            self.total += row.units
        return row.account, row.seq, row.at, row.units, ok


def budget_ledger(ops: DataFrame, cap: float) -> DataFrame:
    """Reserve, settle and fail calls under a hard cap (account, seq, id, op, amount)."""

    def fold():
        open_: dict[str, float] = {}  # only calls that can still change
        total = 0.0

        def step(row):
            nonlocal total
            if row.op == "reserve":
                ok = row.id not in open_ and total + row.amount <= cap
                if ok:
                    open_[row.id] = row.amount
                    total += row.amount
            else:  # settle at a price, fail at the reserved price, or fail unbilled
                price = {"settle": row.amount, "failed": open_.get(row.id), "unbilled": 0.0}.get(row.op)
                ok = row.id in open_ and price is not None and price <= open_[row.id] + 1e-12
                if ok:
                    total += price - open_.pop(row.id)
            return row.account, row.seq, row.id, ok, float(total)

        return step

    return _streamed(ops.select("account", "seq", "id", "op", "amount"), fold, BUDGET)


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """Change of each asset's counter against the snapshot before, null where that has none.

    Rows snapshot_id, asset, count; the snapshot before is the next smaller id of the table.
    """
    ids = snapshots.select("snapshot_id").distinct()
    # one row a snapshot
    order = ids.withColumn("before_id", F.lag("snapshot_id").over(Window.orderBy("snapshot_id")))
    old = snapshots.select(F.col("snapshot_id").alias("before_id"), "asset", F.col("count").alias("old"))
    joined = snapshots.join(order, "snapshot_id").join(old, ["before_id", "asset"], "left")
    change = F.col("count") - F.col("old")
    return joined.select("snapshot_id", "asset", "count", change.alias("change"), F.coalesce(change < 0, F.lit(False)).alias("decreased"))


def removed_assets(snapshots: DataFrame, previous: int, latest: int) -> DataFrame:
    old = snapshots.where(F.col("snapshot_id") == previous).select("asset")
    return old.join(snapshots.where(F.col("snapshot_id") == latest).select("asset"), "asset", "left_anti").distinct()


def trailing_days(daily: DataFrame, by: str, day: str, count: str) -> DataFrame:
    """Sums of the trailing seven rows and of the seven before them."""
    window = Window.partitionBy(by).orderBy(day)
    return daily.withColumns(
        {"last_7": F.sum(count).over(window.rowsBetween(-6, 0)), "previous_7": F.coalesce(F.sum(count).over(window.rowsBetween(-13, -7)), F.lit(0))}
    )


def resource_summary(samples: DataFrame, run: str, memory: str, size: str, amount: str, seconds: str) -> DataFrame:
    """Per run: largest memory and size seen, and the overall rate."""
    rate = (F.sum(amount) / F.sum(seconds)).alias("rate")
    return samples.groupBy(run).agg(F.max(memory).alias("peak_memory"), F.max(size).alias("peak_size"), rate)


def request_counters(requests: DataFrame, *by: str) -> DataFrame:
    """Requests and failures (status 400 and above)."""
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("failures"))


def release_assets(names: DataFrame, column: str = "name") -> DataFrame:
    """Version and platform of release archives; other names are left out."""
    pattern = r"^[a-z][a-z0-9-]*-v?(\d+\.\d+\.\d+)-([a-z0-9_-]+)\.(?:tar\.gz|zip)$"
    return names.where(F.col(column).rlike(pattern)).withColumns({"version": F.regexp_extract(column, pattern, 1), "platform": F.regexp_extract(column, pattern, 2)})
