"""Streams: incremental indexing, windowed audit counts, sessions. Extensions beside the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutation import latest
from ..operators.versions import Versions


def audit_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events by type and window (sliding, if slide is given); rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "user_id", "n")


def first_failures(events: DataFrame, most: int = 3, timeout: str = "2 hours") -> DataFrame:
    """user_id, event_id, streak: of each user's stream the event that makes `most` errors in a row; any other event ends a
    row. A custom stateful operator: the state is one number for each user, and goes after `timeout` without events."""
    import pandas as pd

    def run(key, parts, state):
        streak = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
            streak = streak + 1 if kind == "error" else 0
            if streak == most:
                out.append((key[0], event_id, streak))
        state.update((streak,))
        state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak"])

    keyed = events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, event_id long, streak int", "streak int", "append", "ProcessingTimeTimeout")


def upsert_stream(rows: DataFrame, key: str, order: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch replaces the stored rows of its keys; within a batch the last row of a key wins."""

    def apply(batch: DataFrame, epoch: int) -> None:
        new = latest(batch, [key], [F.desc(order)])
        old = read()
        write(new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_folder(rows: DataFrame, key: str, order: str, path: str, checkpoint: str, buckets: int = 64, name: str = "rows") -> StreamingQuery:
    """Keeps the latest row of each key in a relation of a versioned store.

    A micro-batch rewrites the buckets that it touches, and no others, and becomes visible as a whole with its manifest. A
    batch that is given again after a failure is known by its number and changes nothing; one that died on the way
    is not seen, and is applied anew.
    """
    store = Versions(rows.sparkSession, path)

    def apply(batch: DataFrame, epoch: int) -> None:
        store.upsert(name, latest(batch, [key], [F.desc(order)]), key, order, buckets, (checkpoint, epoch))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
