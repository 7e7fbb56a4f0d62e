"""Telemetry samples against a plain pass over each user's readings."""

import random

import pytest

from leafmill.operators import telemetry as M
from leafmill.sources import store

SCHEMA = (
    "user_id long, at long, seq long, busy_ms long, battery_percent int, charging boolean, voltage double, current double, "
    "temperature double, memory_mb long, threads int, accessible boolean, summary_status string, playback string"
)
NAMES = list(M.READINGS)


def some_readings(rng, n):
    values = {
        "battery_percent": lambda: rng.randrange(101), "charging": lambda: rng.random() < 0.5, "voltage": lambda: 3 + rng.randrange(10) / 10,
        "current": lambda: rng.randrange(-50, 50) / 100, "temperature": lambda: 20 + rng.randrange(100) / 10, "memory_mb": lambda: rng.randrange(900),
        "threads": lambda: rng.randrange(1, 40), "accessible": lambda: rng.random() < 0.5, "summary_status": lambda: rng.choice(["working", 'a "b"\nc']),
        "playback": lambda: rng.choice(["speaking", "paused"]),
    }
    return [
        (1 if rng.random() < 0.7 else 2, rng.randrange(n * 2000), i, rng.choice([None, -5, 70, 400]), *[f() if rng.random() < 0.2 else None for f in values.values()])
        for i in range(n)
    ]


def plain_samples(rows):
    out = {}
    for user in {r[0] for r in rows}:
        held, previous, first = dict(M.READINGS), None, None
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: r[1:3])
        for window in sorted({r[1] - r[1] % 5000 for r in mine}):
            busy = 0
            for r in mine:
                if r[1] - r[1] % 5000 == window:
                    busy += max(r[3] or 0, 0)
                    held |= {n: v for n, v in zip(NAMES, r[4:], strict=True) if v is not None}
            first = window if first is None else first
            wall = None if previous is None else window - previous
            watts = None if held["current"] is None or held["voltage"] is None else abs(held["current"]) * held["voltage"]
            load = None if wall is None else (20000 * busy + wall) // (2 * wall)
            out[(user, window)] = ((window - first) // 1000, *held.values(), watts, load)
            previous = window
    return out


@pytest.mark.parametrize("cell", [20_000, M.CELL_MS])
def test_samples_carry_every_column(spark, cell):
    rows = some_readings(random.Random(4), 500)
    odd = [(None, 5, 1, 1, *[None] * 10), (3, None, 1, 1, *[None] * 10)]
    got = M.telemetry_samples(spark.createDataFrame(rows + odd, SCHEMA).repartition(4), 5, cell).collect()
    expected = plain_samples(rows)
    assert len(got) == len(expected)
    for r in got:
        assert tuple(r)[2:] == pytest.approx(expected[(r.user_id, r.window_ms)]), (r.user_id, r.window_ms)
    assert M.telemetry_samples(spark.createDataFrame([], SCHEMA), 5).collect() == []


def test_fields_are_read_back(spark, tmp_path):
    rows = some_readings(random.Random(6), 60)
    fields = M.sample_fields(M.telemetry_samples(spark.createDataFrame(rows, SCHEMA), 5))
    assert fields.columns == ["user_id", *store.SAMPLE_COLUMNS]
    store.write_samples_csv(fields, str(tmp_path / "samples"))
    back = store.read_samples_csv(spark, str(tmp_path / "samples"))
    clean = sorted(tuple(str(v).replace("\n", " ") for v in r) for r in fields.collect())
    assert sorted(tuple(map(str, r)) for r in back.collect()) == clean
