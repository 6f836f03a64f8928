"""Stateful operators: sliding-window limits, change detection, reminders and windowed counts.

Each has a Structured Streaming form; sliding_limits() also has a batch form with the same decisions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decide(times: deque[int], now: int, limit: int, window: int) -> tuple[bool, int]:
    """Whether a request at `now` passes, and the seconds to wait if not. Times at the window's far end are dropped;
    a denied request leaves no trace."""
    while times and times[0] <= now - window:
        times.popleft()
    if len(times) >= limit:
        return False, max(1, (times[0] + window - now) // 1_000_000)
    times.append(now)
    return True, 0


DECISIONS = "key string, event_id long, allowed boolean, retry_after long"
_DECISIONS = pa.schema([("key", pa.string()), ("event_id", pa.int64()), ("allowed", pa.bool_()), ("retry_after", pa.int64())])


def sliding_limits(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decisions for (key, ts, event_id), at most `limit` passed requests of a key in any window.

    A decision depends on earlier decisions, so a key's requests stream in order through one task; its memory is
    `limit` times.
    """
    window = window_seconds * 1_000_000
    timed = requests.select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, times = object(), deque()
        for batch in batches:
            rows = []
            for key, at, event in zip(batch["key"].to_pylist(), batch["at"].to_pylist(), batch["event_id"].to_pylist(), strict=True):
                if key != current:
                    current, times = key, deque()
                allowed, wait = decide(times, at, limit, window)
                rows.append({"key": key, "event_id": event, "allowed": allowed, "retry_after": wait})
            yield pa.RecordBatch.from_pylist(rows, schema=_DECISIONS)

    return timed.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, DECISIONS)


def sliding_limits_stream(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """The streaming form over (key, ts, event_id); a key's state is its passed times, dropped after a quiet window."""
    window = window_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(rows["ts"], rows["event_id"], strict=True):
            allowed, wait = decide(times, int(ts.value // 1000), limit, window)
            out.append((key[0], event, allowed, wait))
        state.update((list(times),))
        state.setTimeoutDuration(window_seconds * 1000)
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "retry_after"])

    return requests.groupBy("key").applyInPandasWithState(step, DECISIONS, "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def hash_changes_stream(observed: DataFrame) -> DataFrame:
    """(source_id, change) for a stream of (source_id, content_hash): initialised, changed or unchanged."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for value in frame["content_hash"]:
                out.append((key[0], "initialised" if last is None else "changed" if value != last else "unchanged"))
                last = value
        state.update((last,))
        yield pd.DataFrame(out, columns=["source_id", "change"])

    return observed.groupBy("source_id").applyInPandasWithState(step, "source_id string, change string", "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", *by: str) -> DataFrame:
    """Counts per tumbling window and group; rows later than the watermark are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


def due_reminders(reminders: DataFrame, opted_out: DataFrame, now) -> DataFrame:
    """Reminders (id, owner, due_at, status) to deliver: due, scheduled or snoozed, owner not opted out."""
    due = reminders.filter((F.col("due_at") <= now) & F.col("status").isin("scheduled", "snoozed"))
    return due.join(opted_out.select("owner"), "owner", "left_anti").withColumns({"status": F.lit("delivered"), "delivered_at": now})
