"""Stateful processors on transformWithState: sliding-window limits, token families and invitation seats by event time.

A processor sees the rows of a key in the order of their event time, in whatever order micro-batches bring them within
the watermark's delay: rows wait in list state until the watermark has passed them. Timers of event time wake a key
for its waiting rows and for what falls due without a row, such as a seat that expires. State that a key no longer
needs is cleared by such a timer; a time to live of the state store itself exists in processing time only.
The state store must be RocksDB (ROCKSDB below).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import decide

#: Settings that transformWithState needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SECOND = 1_000_000


class Ordered(StatefulProcessor):
    """Rows (at in microseconds, event_id, kind) of a key in order of time and id; `step` handles one, `due` a moment without one.

    Subclasses name their output columns and hold their own state; it lives in value or list state between calls.
    """

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: str, at: int, event_id: int, kind: str) -> list[tuple]:
        raise NotImplementedError

    def due(self, key: str, now: int) -> list[tuple]:
        """Called when the watermark has reached `now`, after the rows up to it."""
        return []

    def next_due(self) -> int | None:
        """The next moment at which due() has something to do, in microseconds."""
        return None

    def _wake(self, at: int | None) -> None:
        if at is not None:
            self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(e), k) for f in rows for a, e, k in zip(f["at"], f["event_id"], f["kind"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(a for a, _, _ in new))
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name, now = key[0], timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        out: list[tuple] = []
        for at, event_id, kind in (r for r in waiting if r[0] <= now):
            # What fell due before this row comes first.
            while (moment := self.next_due()) is not None and moment <= at:
                out += self.due(name, moment)
            out += self.step(name, at, event_id, kind)
        while (moment := self.next_due()) is not None and moment <= now:
            out += self.due(name, moment)
        left = [r for r in waiting if r[0] > now]
        if left:
            self.waiting.put(left)
            self._wake(left[0][0])
        else:
            self.waiting.clear()
        self._wake(self.next_due())
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Limiter(Ordered):
    """At most `limit` requests of a key pass in any window; the state is the passed times, cleared a window after the last."""

    columns = ["key", "event_id", "allowed", "retry_after"]
    schema = "key string, event_id long, allowed boolean, retry_after long"

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * SECOND

    def open(self, handle):
        self.times = handle.getListState("times", "at long")

    def _held(self) -> deque[int]:
        return deque(sorted(t for (t,) in self.times.get())) if self.times.exists() else deque()

    def step(self, key, at, event_id, kind):
        times = self._held()
        allowed, wait = decide(times, at, self.limit, self.window)
        self.times.put([(t,) for t in times])
        return [(key, event_id, allowed, wait)]

    def next_due(self):
        held = self._held()
        return held[-1] + self.window if held else None

    def due(self, key, now):
        self.times.clear()
        return []


class TokenFamily(Ordered):
    """A family's token is rotated by the first row of kind `rotate`; every use after that moment is a reuse, the first revokes.

    A family without a row for `keep_seconds` is forgotten, as its tokens have expired by then; None keeps it.
    """

    columns = ["key", "event_id", "at", "revokes"]
    schema = "key string, event_id long, at long, revokes boolean"

    def __init__(self, keep_seconds: int | None = None):
        self.keep = None if keep_seconds is None else keep_seconds * SECOND

    def open(self, handle):
        self.family = handle.getValueState("family", "rotated long, reused boolean, last long")

    def step(self, key, at, event_id, kind):
        rotated, reused, _ = self.family.get() if self.family.exists() else (None, False, at)
        reuse = rotated is not None and at > rotated
        if rotated is None and kind == "rotate":
            rotated = at
        self.family.update((rotated, reused or reuse, at))
        return [(key, event_id, at, not reused)] if reuse else []

    def next_due(self):
        return self.family.get()[2] + self.keep if self.keep is not None and self.family.exists() else None

    def due(self, key, now):
        self.family.clear()
        return []


class Seat(Ordered):
    """An invitation: its first row issues it, `reserve` holds a seat, `verify` within its time redeems it, else a timer expires it.

    Emits each change of state with its moment: pending, reserved, redeemed or expired. Only the first row of a kind counts.
    """

    columns = ["key", "state", "at"]
    schema = "key string, state string, at long"

    def __init__(self, base_seconds: int, step_seconds: int = 0):
        self.base, self.extra = base_seconds * SECOND, step_seconds * SECOND

    def open(self, handle):
        self.seat = handle.getValueState("seat", "state string, expires long, reserved long, verified long")

    def step(self, key, at, event_id, kind):
        state, expires, reserved, verified = self.seat.get() if self.seat.exists() else (None, at + self.base + self.extra * (int(key) % 1000), None, None)
        before, reserved = state, at if kind == "reserve" and reserved is None else reserved
        verified = at if kind == "verify" and verified is None else verified
        if state not in ("redeemed", "expired"):
            redeemed = reserved is not None and verified is not None and reserved <= verified and reserved < expires and verified < expires
            state = "redeemed" if redeemed else "reserved" if reserved is not None else "pending"
        self.seat.update((state, expires, reserved, verified))
        return [(key, state, at)] if state != before else []

    def next_due(self):
        if not self.seat.exists():
            return None
        state, expires, _, _ = self.seat.get()
        return expires if state in ("pending", "reserved") else None

    def due(self, key, now):
        _, expires, reserved, verified = self.seat.get()
        self.seat.update(("expired", expires, reserved, verified))
        return [(key, "expired", now)]


def processed(events: DataFrame, processor: Ordered, late: str = "10 minutes") -> DataFrame:
    """The processor's output for a stream of (key, ts, event_id, kind), rows up to `late` behind the latest included."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    timed = timed.select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at"), "event_id", "kind")
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="append", timeMode="eventtime")
