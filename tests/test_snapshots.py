"""States from snapshots equal states from all points, and read one snapshot and one period."""

import random
import re

import pytest

from jobtally.operators.replay import state_at
from jobtally.operators.snapshots import SnapshotStore

SCHEMA = "timestamp long, job_id string, operation string, value long"


def some_points(spark, periods, seed=0):
    """Points of periods of 100 s; period 3 and 4 have none, and series come and go."""
    rng, rows = random.Random(seed), {}
    for period in periods:
        if period in (3, 4):
            continue
        for _ in range(60):
            at = period * 100 + rng.randrange(100)
            rows[at, f"j{rng.randrange(6)}", rng.choice(["open", "read"])] = rng.randrange(1000)
    return spark.createDataFrame([(*key, value) for key, value in rows.items()], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "s"), 100)


def check(store, rows, points, times):
    for at in times:
        assert rows(store.state_at(at), "job_id", "operation", "value", "timestamp") == rows(state_at(points, at), "job_id", "operation", "value", "timestamp"), at


def test_states_equal_those_from_all_points(spark, store, rows):
    points = some_points(spark, range(8))
    store.replace(points)
    check(store, rows, points, [-1, 0, 55, 99, 100, 350, 499, 500, 677, 5000])


def test_periods_are_added_and_replaced(spark, store, rows):
    assert store.state_at(100).count() == 0
    store.replace(some_points(spark, range(0)))
    assert store.state_at(100).count() == 0
    parts = {n: some_points(spark, [n], n) for n in (0, 1, 2, 5, 6)}
    for n in (0, 1, 2, 5, 6):
        store.replace(parts[n])
    parts[2] = some_points(spark, [2], 99)  # corrected later: states from there on follow
    store.replace(parts[2])
    points = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[5]).unionByName(parts[6])
    check(store, rows, points, [50, 199, 250, 460, 555, 700])
    store.replace(parts[1])  # taken in twice
    check(store, rows, points, [250, 700])


def test_one_snapshot_and_one_period_are_read(spark, store):
    store.replace(some_points(spark, range(8)))
    plan = store.state_at(677)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    assert sorted(re.findall(r"period#\d+L = (\d+)", "".join(filters))) == ["5", "6"] and len(filters) == 2
    assert "PushedFilters: [IsNotNull(timestamp), LessThanOrEqual(timestamp,677)" in plan


def test_a_period_is_no_shorter_than_a_second(spark):
    with pytest.raises(ValueError):
        SnapshotStore(spark, "x", 0)
