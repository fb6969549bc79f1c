"""Failures in a row: batch against plain Python, stream against batch, late events dropped, state that ends."""

import datetime as dt
import random

import pytest

from blastradius.streaming import streaks

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def plain(events, most=3, gap=dt.timedelta(hours=2)):
    out, state = set(), {}
    for user, i, ts, kind in sorted(events, key=lambda e: (e[2], e[1])):
        n, last = state.get(user, (0, None))
        n = 0 if last and ts > last + gap else n
        n = n + 1 if kind == "error" else 0
        state[user] = n, ts
        if n == most:
            out.add((user, i, n))
    return out


def made(seed, n=200):
    r = random.Random(seed)
    return [(r.randrange(5), i, at(r.randrange(3000)), r.choice(["error", "error", "error", "view"])) for i in range(n)]


def test_batch(spark):
    events = made(1)
    got = streaks.batch(spark.createDataFrame(events, SCHEMA))
    assert {tuple(r) for r in got.collect()} == plain(events) and plain(events)
    odd = spark.createDataFrame([(1, 1, None, "error"), (None, 2, at(1), "error"), (None, 3, at(1), "error"), (None, 4, at(2), "error"), (1, 5, at(1), None)], SCHEMA)
    assert [tuple(r) for r in streaks.batch(odd).collect()] == [(None, 4, 3)]
    assert streaks.batch(odd.limit(0)).count() == 0


@pytest.fixture
def session(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, streaks.PROVIDER)
    yield spark
    spark.conf.set(key, old)


def run(spark, path, parts, name):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{i}")
        source = spark.readStream.schema(SCHEMA).parquet(f"{path}/in/*")
        q = streaks.stream(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    return {tuple(r) for r in spark.read.schema(streaks.SCHEMA).parquet(f"{path}/out").collect()}


def test_stream_equals_batch(session, tmp_path):
    """Events come out of order within ten minutes, over several batches."""
    events = sorted(made(2, 120), key=lambda e: e[2])
    shuffled = sorted(events, key=lambda e: e[2] + dt.timedelta(minutes=random.Random(e[1]).randrange(9)))
    end = [(99, 999, at(5000), "view")]  # moves the watermark beyond all others
    got = run(session, str(tmp_path), [shuffled[:50], shuffled[50:90], [*shuffled[90:], *end]], "streaks")
    assert got == plain(events) and got


def test_late_events_are_dropped(session, tmp_path):
    first = [(1, 1, at(0), "error"), (1, 2, at(1), "error"), (2, 7, at(300), "view")]
    late = [(1, 3, at(2), "error"), (2, 8, at(301), "view")]  # event 3 is below the watermark by then
    end = [(9, 9, at(900), "view")]
    assert run(session, str(tmp_path), [first, late, end], "late") == set()
    assert plain([*first, *late]) == {(1, 3, 3)}
