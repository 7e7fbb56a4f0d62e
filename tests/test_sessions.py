"""Sessions and throttle in event time: composed maps, pointers and timers against one plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators.ordering import entries, ranked, sum_before
from leafmill.streaming import run as R
from leafmill.streaming import sessions as S

START = datetime(2024, 1, 1)


def plain_throttle(rows, interval):
    out, last = set(), {}
    for user, ms, event in sorted(rows):
        if user not in last or ms - last[user] >= interval:
            out.add((user, event, ms))
            last[user] = ms
    return out


def plain_sessions(steps, max_steps=10, max_stalled=2):
    out, states = set(), {}
    for user, event, fresh, chars in sorted(steps):
        session, n, stalled, blocks, size = states.get(user, (0, 0, 0, 0, 0))
        n, blocks, size, stalled = n + 1, blocks + fresh, size + chars * (fresh > 0), 0 if fresh else stalled + 1
        if n >= max_steps or stalled >= max_stalled:
            out.add((user, session, n, blocks, size))
            states[user] = (session + 1, 0, 0, 0, 0)
        else:
            states[user] = (session, n, stalled, blocks, size)
    return out


def test_places_totals_and_prefixes(spark):
    rows = spark.createDataFrame([(1 if i < 90 else i, i % 5) for i in range(95)], "g long, v long").repartition(6)
    placed = ranked(rows, "g", [F.col("v")], "test").cache()
    mine = sorted((r.pos, r.v, r.n) for r in placed.collect() if r.g == 1)
    assert [m[0] for m in mine] == list(range(90)) and [m[1] for m in mine] == sorted(m[1] for m in mine) and mine[0][2] == 90
    for cell in (4, 1000):
        got = sorted((r.pos, r.before) for r in sum_before(placed.filter("g = 1"), "g", "pos", "v", cell).collect())
        assert [b for _, b in got] == [sum(m[1] for m in mine[:i]) for i in range(90)]
    rng = random.Random(2)
    maps = [[rng.randrange(5) for _ in range(5)] for _ in range(70)]
    units = spark.createDataFrame([(1, 10 + 3 * i, m) for i, m in enumerate(maps)] + [(2, 500, [0])], "k long, place long, map array<int>")
    at, expected = 0, {(2, 500, 0)}
    for i, m in enumerate(maps):
        expected.add((1, 10 + 3 * i, at))
        at = m[at]
    for fan_in in (2, 16, 1000):
        assert {tuple(r) for r in entries(units, "k", fan_in).collect()} == expected


@pytest.mark.parametrize("interval,block", [(1000, 64_000), (1000, 2000), (7000, 1), (50, 200)])
def test_throttle_of_a_hot_user(spark, interval, block):
    rng = random.Random(interval)
    rows = [(1, 1_700_000_000_000 + rng.randrange(900_000)) for _ in range(2500)] + [(2, 5 + i * 997) for i in range(300)]
    rows = [(u, ms, i) for i, (u, ms) in enumerate(rows + [(3, -50), (3, -49), (3, 10**9), (3, 10**9)])]
    frame = spark.createDataFrame(rows, "user_id long, ms long, event_id long").select("user_id", "event_id", F.timestamp_millis("ms").alias("ts"))
    odd = spark.createDataFrame([(None, 1, None), (4, 1, None)], "user_id long, event_id long, ts timestamp")
    got = [tuple(r) for r in S.throttled(frame.unionByName(odd), interval, block).collect()]
    assert set(got) == plain_throttle(rows, interval) and len(got) == len(set(got))


def test_throttle_of_nothing(spark):
    empty = spark.createDataFrame([], "user_id long, event_id long, ts timestamp")
    assert S.throttled(empty).collect() == []
    assert S.capture_sessions(S.session_steps(empty.withColumn("k", F.lit(1)))).collect() == []


@pytest.mark.parametrize("cell", [256, 16, 3])
def test_sessions_of_a_hot_user(spark, cell):
    rng = random.Random(cell)
    steps = [(u, i, rng.choice([0, 0, 1, 2]), i % 50) for i, u in enumerate([1] * 1500 + [2] * 7 + [3] * 300)]
    rng.shuffle(steps)
    frame = spark.createDataFrame(steps, "user_id long, event_id long, fresh long, chars long").withColumn("ts", F.timestamp_seconds("event_id"))
    got = [tuple(r) for r in S.capture_sessions(frame, cell=cell).collect()]
    assert set(got) == plain_sessions(steps) and len(got) == len(set(got))
    other = {tuple(r) for r in S.capture_sessions(frame, 40, 4, 3, cell).collect()}
    assert other == {s for s in plain_sessions(steps, 4, 3) if s[-1] >= 40}


def _files(spark, folder, rows):
    """One file for each list of (event_id, seconds, user_id, k), in the order of arrival."""
    for part in rows:
        data = [(e, START + timedelta(seconds=s), u, "view", 1.0, f'{{"k": {k}}}') for e, s, u, k in part]
        spark.createDataFrame(data, R.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_streams_keep_event_time(spark, tmp_path):
    """Files out of order within the delay give the batch result; later rows are left out and land in the late table."""
    rng = random.Random(7)
    rows = [(i, i * 20, i % 3, rng.randrange(100)) for i in range(240)]
    rng2 = random.Random(8)
    shuffled = sorted(rows, key=lambda r: r[1] + rng2.randrange(500))
    parts = [shuffled[i : i + 24] for i in range(0, 240, 24)]
    late = (999, 3, 1, 50)
    parts[-1] = [*parts[-1], late]
    _files(spark, tmp_path, parts)
    events = lambda: R.stream_events(spark, str(tmp_path), 1)
    got = R.run_to_end(spark, events(), lambda e: S.session_stream(S.session_steps(e), "10 minutes"), "test").collect()
    steps = [(u, s, k % 3, 2 * k) for _, s, u, k in rows]
    assert {tuple(r) for r in got} == plain_sessions(steps) and len(got) == len(plain_sessions(steps))
    got = R.run_to_end(spark, events(), lambda e: S.throttle_stream(e, "10 minutes", 70_000), "test").collect()
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1000
    assert {tuple(r) for r in got} == plain_throttle([(u, base + s * 1000, e) for e, s, u, _ in rows], 70_000)
    dropped = R.read_back(spark, R.run_once(events(), "late", sink=S.late_sink(600_000))).collect()
    assert [r.event_id for r in dropped] == [late[0]]
