"""Stateful operators over events in the order of their time, whatever order and micro-batches they come in.

A key's events wait in its state until the watermark has passed them, and then are worked off by time and id.  So the result is that of the batch operators for any split into micro-batches and any
order within the lateness; events that come after the watermark has passed them are dropped.  Timers run on event time.  The state needs Spark's RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Keeps events (``at`` in microseconds, ``event_id`` and the columns of ``payload``) until they are due and hands them to ``step`` in order."""

    def __init__(self, payload: str) -> None:
        self.payload = payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, event_id bigint{', ' if self.payload else ''}{self.payload}")

    def wake(self, at: int) -> None:
        """A timer for a moment in microseconds; the watermark counts whole milliseconds."""
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            columns = [c for c in ("at", "event_id", *self.names()) if c in batch]
            # The state takes plain Python values, null for a missing one.
            new = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in row) for row in batch[columns].itertuples(index=False)]
            self.waiting.appendList(new)
            self.arrived(batch)
            first = int(batch["at"].min())
            least = first if least is None else min(least, first)
        if least is not None:
            self.wake(least)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self.wake(later[0][0])
        out = self.step(key, due, now)
        if out is not None and len(out):
            yield out

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.payload.split(", ")] if self.payload else []

    def arrived(self, batch: pd.DataFrame) -> None:
        """Sees a batch when it comes."""

    def step(self, key: tuple, due: list, now: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Admission(InOrder):
    """The times of a client's admitted calls within one window; they go when the watermark has passed the window after the last one."""

    def __init__(self, max_calls: int, window: int) -> None:
        super().__init__("")
        self.max_calls, self.window = max_calls, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "times array<bigint>")

    def step(self, key: tuple, due: list, now: int) -> pd.DataFrame | None:
        seen, out = deque(self.seen.get()[0] if self.seen.exists() else ()), []
        for at, event_id in due:
            while seen and seen[0] <= at - self.window:
                seen.popleft()
            ok = len(seen) < self.max_calls
            if ok:
                seen.append(at)
            out.append((key[0], event_id, ok))
        if seen and seen[-1] + self.window <= now:
            seen.clear()
        if seen:
            self.seen.update((list(seen),))
            if due:
                self.wake(seen[-1] + self.window)
        elif self.seen.exists():
            self.seen.clear()
        return pd.DataFrame(out, columns=["client", "event_id", "admitted"]) if out else None


def admitted(requests: DataFrame, max_calls: int, window_s: float = 60.0, *, late: str = "1 minute") -> DataFrame:
    """client, event_id, admitted, as ``library.admit``; ``requests`` is a stream of client, event_id and ts."""
    timed = requests.withWatermark("ts", late).select("client", "event_id", "ts", F.unix_micros("ts").alias("at"))
    processor = Admission(max_calls, round(window_s * 1e6))
    return timed.groupBy("client").transformWithStateInPandas(processor, "client long, event_id long, admitted boolean", "Append", "EventTime")


class Completion(InOrder):
    """The last status of each of a batch's papers, until the batch is reported once."""

    def __init__(self) -> None:
        super().__init__("paper_id bigint, status string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getMapState("last", "paper_id bigint", "status string")
        #: Papers of the batch, deadline, how many are settled and how many of them completed, and whether the batch is reported.
        self.batch = handle.getValueState("batch", "total bigint, deadline bigint, settled bigint, completed bigint, reported boolean")

    def arrived(self, batch: pd.DataFrame) -> None:
        if not self.batch.exists():
            first = batch.iloc[0]
            self.batch.update((int(first["total"]), int(first["deadline"]), 0, 0, False))
            self.wake(int(first["deadline"]) + 1)

    def step(self, key: tuple, due: list, now: int) -> pd.DataFrame | None:
        total, deadline, settled, completed, reported = self.batch.get()
        if reported:
            return None
        for at, _, paper, status in due:
            if at > deadline:
                break
            before = self.last.getValue((paper,))[0] if self.last.containsKey((paper,)) else "pending"
            is_settled = lambda s: s is None or s in ("completed", "failed")
            settled += is_settled(status) - is_settled(before)
            completed += (status == "completed") - (before == "completed")
            self.last.updateValue((paper,), (status,))
            if settled == total:
                return self.report(key, (at, total, completed, total - completed, True), total, deadline)
        if now > deadline:
            return self.report(key, (deadline, total, 0, 0, False), total, deadline)
        self.batch.update((total, deadline, settled, completed, False))
        return None

    def report(self, key: tuple, row: tuple, total: int, deadline: int) -> pd.DataFrame:
        self.last.clear()
        self.batch.update((total, deadline, 0, 0, True))  # what comes later says nothing new
        return pd.DataFrame([(key[0], *row)], columns=["batch_id", "at", "total", "completed", "failed", "done"])


def batch_completions(progress: DataFrame, batches: DataFrame, timeout_s: float = 600.0, grace_s: float = 60.0, *, late: str = "1 minute") -> DataFrame:
    """batch_id, at (microseconds), total, completed, failed, done, as ``library.batch_completions``, for each batch that has an event: when its last paper is settled, or when its time is up.

    ``progress`` is a stream of batch_id, paper_id, event_id, ts and status, ``batches`` a table of batch_id, paper_id and started.
    """
    known = batches.groupBy("batch_id").agg(F.countDistinct("paper_id").alias("total"), (F.unix_micros(F.min("started").cast("timestamp")) + round((timeout_s + grace_s) * 1e6)).alias("deadline"))
    members = batches.select("batch_id", "paper_id").distinct().join(known, "batch_id")
    timed = progress.withWatermark("ts", late).join(members, ["batch_id", "paper_id"])
    timed = timed.select("batch_id", "paper_id", "event_id", "ts", F.unix_micros("ts").alias("at"), F.lower("status").alias("status"), "total", "deadline")
    return timed.groupBy("batch_id").transformWithStateInPandas(Completion(), "batch_id long, at long, total long, completed long, failed long, done boolean", "Append", "EventTime")
