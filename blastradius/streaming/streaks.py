"""Failures in a row, by event time: a state machine for each user, as a stream and as a batch.

The stream holds events back until the watermark has passed them, and then takes them in the order of their times, so
that it gives what the batch gives whatever the order in which events come; events below the watermark are dropped.
Timers are in event time: one wakes a user's machine for its next event, one ends its state after `timeout` without events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "user_id long, event_id long, streak int"
#: What a session that runs the stream must say.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch(events: DataFrame, most: int = 3, timeout: str = "2 hours") -> DataFrame:
    """user_id, event_id, streak: of each user the events that make `most` errors in a row. Another event ends a row of
    errors, and so does a time of more than `timeout` without events; after `most` the row goes on and is told once."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    error = F.coalesce(F.col("event_type") == "error", F.lit(False))
    gap = F.col("ts") > F.lag("ts").over(order) + F.expr(f"interval {timeout}")
    rows = events.where("ts IS NOT NULL").withColumn("__begins", (~error | F.coalesce(gap, F.lit(False))).cast("int"))
    rows = rows.withColumn("__row", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak", F.count_if(error).over(Window.partitionBy("user_id", "__row").orderBy("ts", "event_id")).cast("int"))
    return rows.where(error & (F.col("streak") == most)).select("user_id", "event_id", "streak")


class Streaks(StatefulProcessor):
    """Times are microseconds in the state and milliseconds in timers."""

    def __init__(self, most: int, timeout_ms: int):
        self.most, self.timeout = most, timeout_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts long, event_id long, error boolean")
        self.streak = handle.getValueState("streak", "n int, last long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803 (Spark's names)
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(ts.value // 1000), int(i), kind == "error") for part in rows for ts, i, kind in zip(part["ts"], part["event_id"], part["event_type"], strict=True)]
        for event in new:
            if event[0] > seen:
                self.pending.appendValue(event)
        if new:
            self.wake(min(e[0] for e in new))
        return iter(())

    def wake(self, at: int) -> None:
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N803
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(e[0]), int(e[1]), bool(e[2])) for e in self.pending.get())
        due, later = [e for e in held if e[0] <= passed], [e for e in held if e[0] > passed]
        n, last = self.streak.get() if self.streak.exists() else (0, None)
        out = []
        for ts, event_id, error in due:
            if last is not None and ts > last + self.timeout:
                n = 0
            n, last = n + 1 if error else 0, ts
            if n == self.most:
                out.append((key[0], event_id, n))
        if due or later:
            self.pending.put(later) if later else self.pending.clear()
        if last is not None and not later and passed > last + self.timeout:
            self.streak.clear()  # nothing can go on from here
        elif due:
            self.streak.update((n, last))
            self.wake(last + self.timeout)
        if later:
            self.wake(later[0][0])
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak"]).astype({"user_id": "int64", "event_id": "int64", "streak": "int32"})

    def close(self) -> None:
        pass


def stream(events: DataFrame, most: int = 3, timeout_ms: int = 7_200_000, late: str = "10 minutes") -> DataFrame:
    """The same over a stream of user_id, event_id, ts, event_type; events later than `late` are dropped."""
    keyed = events.select("user_id", "event_id", "ts", "event_type").where("ts IS NOT NULL").withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(Streaks(most, timeout_ms), SCHEMA, "append", "eventTime")
