"""Keyed state with timers: periods of activity of a key, told when it has been idle for long enough.

The state of a key is its open periods (start, last and number of events, in microseconds). Events may come in any order as long as the
watermark has not passed them: an event joins the periods that it lies within `idle` of, and may join two of them to one. A timer is set at
the end of each period's wait; when the watermark passes it, the period is told and leaves the state, so a key's state is what is open.
State and timers live in the checkpoint: a query that is started again goes on where it ended, and a replayed batch changes nothing.

A processor is called in Python for every key of a batch and every timer. `sessions` tells the same periods by session windows, whose state and
time-outs stay in Spark, so it costs rows and not calls: it is for streams of many keys, the processor for rules that no window says.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def joined(periods: list[tuple[int, int, int]], times: list[int], idle: int) -> list[tuple[int, int, int]]:
    """Open periods with further events: what lies less than `idle` apart is one period."""
    out: list[list[int]] = []
    for start, last, n in sorted([*periods, *((t, t, 1) for t in times)]):
        if out and start < out[-1][1] + idle:
            out[-1][1], out[-1][2] = max(out[-1][1], last), out[-1][2] + n
        else:
            out.append([start, last, n])
    return [tuple(p) for p in out]


class Periods(StatefulProcessor):
    """One key's periods; emits (key, start, last, n)."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long")

    def ends(self, period: tuple[int, int, int]) -> int:
        """The millisecond at which a period's wait is over."""
        return -(-(period[1] + self.idle) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(int(v) for v in p) for p in self.open.get()] if self.open.exists() else []
        after = joined(before, [int(t) for part in rows for t in part.iloc[:, -1]], self.idle)
        self.open.put(after)
        wanted = {self.ends(p) for p in after}
        for t in {self.ends(p) for p in before} - wanted:
            self.handle.deleteTimer(t)
        for t in wanted:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(int(v) for v in p) for p in self.open.get()] if self.open.exists() else []
        done, rest = [p for p in held if self.ends(p) <= now], [p for p in held if self.ends(p) > now]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        if done:
            yield pd.DataFrame({"key": [str(key[0])] * len(done), "start": [p[0] for p in done], "last": [p[1] for p in done], "n": [p[2] for p in done]})

    def close(self) -> None:
        pass


def activity(events: DataFrame, *, key: str, time: str, idle_seconds: int, late: str) -> DataFrame:
    """(key as text, start, last, n) of each period of a stream after which its key was idle for idle_seconds; events behind the watermark are left out."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("__time")).withWatermark("__time", late).withColumn("__at", F.unix_micros("__time"))
    out = e.groupBy("key").transformWithStateInPandas(Periods(idle_seconds * 1_000_000), "key string, start long, last long, n long", "Append", "eventtime")
    return out.select("key", F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n")


def sessions(events: DataFrame, *, key: str, time: str, idle_seconds: int, late: str) -> DataFrame:
    """As `activity`, by session windows. An event is left out once its own wait is over; one that is behind the watermark by less joins what is still open, or begins a period of its own."""
    e = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("__time")).withWatermark("__time", late)
    w = F.session_window("__time", f"{idle_seconds * 1_000_000 - 1} microseconds")  # windows that touch are joined, events `idle` apart are not
    return e.groupBy("key", w).agg(F.min("__time").alias("start"), F.max("__time").alias("last"), F.count("*").alias("n")).select("key", "start", "last", "n")
