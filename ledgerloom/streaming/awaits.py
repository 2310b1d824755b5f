"""Awaits and completions as stateful streams: timers end what nothing else ends, and a bounded set forgets by count."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "execution_id string, wait_id string, outcome string, status string, resolved_at timestamp"


def _millis(at) -> int:
    return int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(at).tzinfo is None else int(pd.Timestamp(at).timestamp() * 1000)


def _time(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, timezone.utc).replace(tzinfo=None)


class Awaits(StatefulProcessor):
    """One execution: its final status once it has one, and who waits for it until when.

    A wait is answered once: at once if the execution has ended, else when it ends, else by its
    timer. Timers are in event time, so an answer that was in time is not lost to a late batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "status string, at long")
        self.waits = handle.getMapState("waits", "wait_id string", "asked long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for row in batch.sort_values("at").itertuples():
                at = _millis(row.at)
                if row.wait_id is None or row.wait_id != row.wait_id:
                    if not self.end.exists() or at < self.end.get()[1]:
                        self.end.update((row.status, at))
                else:
                    due = _millis(row.due_at)
                    self.waits.updateValue((row.wait_id,), (at, due))
                    self.handle.registerTimer(due)
        if self.end.exists():
            status, ended = self.end.get()
            for (wait,), (asked, due) in list(self.waits.iterator()):
                if ended <= due:
                    out.append((key[0], wait, "caught_up" if ended <= asked else "ended", status, _time(max(ended, asked))))
                    self.waits.removeKey((wait,))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (wait,), (_, due) in list(self.waits.iterator()):
            if due <= now:
                out.append((key[0], wait, "timed_out", None, _time(due)))
                self.waits.removeKey((wait,))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["execution_id", "wait_id", "outcome", "status", "resolved_at"])
        return frame.astype({"resolved_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def awaited(waits: DataFrame, ends: DataFrame, late: str = "1 minute") -> DataFrame:
    """The stream of answers to ``waits`` (``execution_id, wait_id, asked_at, due_at``) from ``ends`` (``execution_id, status, at``).

    The same rule as the one over tables, but for ends that come later than ``late``. It needs the RocksDB state store.
    """
    a = waits.select("execution_id", "wait_id", F.lit(None).cast("string").alias("status"), F.col("asked_at").alias("at"), "due_at")
    b = ends.select("execution_id", F.lit(None).cast("string").alias("wait_id"), "status", "at", F.lit(None).cast("timestamp").alias("due_at"))
    rows = a.unionByName(b).withWatermark("at", late)
    return rows.groupBy("execution_id").transformWithStateInPandas(statefulProcessor=Awaits(), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")


class RecentSet(StatefulProcessor):
    """The last used ids of one scope, as many as there is room for; an id that is not among them is new."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "id string", "n long")
        self.clock = handle.getValueState("clock", "n long, size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, size = self.clock.get() if self.clock.exists() else (0, 0)
        held = {x: m for (x,), (m,) in self.used.iterator()}
        held = dict(sorted(held.items(), key=lambda x: x[1]))  # oldest first; a use moves an id to the end
        out, touched = [], set()
        for batch in rows:
            for row in batch.sort_values(["at", "number"]).itertuples():
                n += 1
                new = row.id not in held
                held.pop(row.id, None)
                held[row.id] = n
                touched.add(row.id)
                if new and len(held) > self.capacity:
                    oldest = next(iter(held))
                    del held[oldest]
                    touched.discard(oldest)
                    if self.used.containsKey((oldest,)):
                        self.used.removeKey((oldest,))
                out.append((key[0], row.number, row.id, new))
        for x in touched:
            self.used.updateValue((x,), (held[x],))
        self.clock.update((n, len(held)))
        yield pd.DataFrame(out, columns=["scope", "number", "id", "is_new"])

    def close(self) -> None:
        pass


def recently_seen(rows: DataFrame, capacity: int = 10_000) -> DataFrame:
    """``scope, number, id, is_new`` of a stream of ``scope, number, id, at``, by the order of ``at`` and ``number`` within a batch."""
    out = "scope string, number long, id string, is_new boolean"
    return rows.groupBy("scope").transformWithStateInPandas(statefulProcessor=RecentSet(capacity), outputStructType=out, outputMode="Append", timeMode="None")
