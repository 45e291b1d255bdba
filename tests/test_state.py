"""Keyed state: rates per job and retained series, on shuffled arrival and over restarts."""

import os
import random

import pytest
from conftest import framed
from pyspark.sql import functions as F
from test_streaming import COLUMNS, POLLS, batch_table, log_of

from jobtally.operators import filters, merge, rates, series
from jobtally.session import ROCKSDB, STATE_STORE
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.raw_log import read_raw_log, stream_raw_log
from jobtally.streaming import feed, state

pytest.importorskip("google.protobuf")


@pytest.fixture(scope="module")
def spark(spark):
    """Few partitions: batches are small here and many."""
    few = spark.newSession()
    few.conf.set("spark.sql.shuffle.partitions", "2")
    return few


@pytest.fixture
def shuffled(tmp_path):
    """Logs of all polls and hosts that appear in random order."""
    folder = tmp_path / "logs"
    folder.mkdir()
    files = [(poll, host) for poll in range(POLLS) for host in range(2)]
    random.Random(7).shuffle(files)
    for at, (poll, host) in enumerate(files):
        path = folder / f"{poll:03}-{host}.raw"
        path.write_text(log_of(poll, host))
        os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))
    return folder


def flush(folder, time="2024-01-01T00:20:00+00:00", name="zzz"):
    (folder / f"{name}.raw").write_text(framed("oss0", "p", time, "job_stats:\n"))


def run_keyed(spark, folder, base, out, delay="200 seconds", mode="rate"):
    merged = feed.stream_merge(stream_raw_log(spark, str(folder), 7), delay)
    handler = feed.KeyedRateFeed(f"{base}/state", {"t": feed.batch_table(out)}, mode)
    query = feed.writer(state.job_changes(merged, mode), handler, f"{base}/checkpoint", None).start()
    assert query.awaitTermination(300) and query.exception() is None
    return handler


def test_keyed_rates_of_shuffled_polls_equal_batch_rates(spark, rows, shuffled, tmp_path):
    base, out = str(tmp_path / "run"), str(tmp_path / "rates")
    run_keyed(spark, shuffled, base, out)
    assert spark.read.schema("poll_ts long").parquet(out).isEmpty()  # the watermark holds all back
    flush(shuffled)
    handler = run_keyed(spark, shuffled, base, out)  # another run goes on from the state of the first
    expected = rates.job_rates(batch_table(spark, str(shuffled)))
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected, *COLUMNS)
    # No more than the time of one poll is kept beside the state store.
    kept = [handler.reference(spark, n) for n in range(12)]
    assert {(k.count() > 1, len(k.columns)) for k in kept if k is not None} == {(False, 1)}


@pytest.fixture
def changes(spark, tmp_path):
    """What the keyed state makes of given counters: rows of (poll, job, snapshot time, open)."""

    def run(counters, keep=3600):
        folder = tmp_path / "in"
        folder.mkdir()
        for poll in sorted({c[0] for c in counters}):
            jobs = [f"- job_id: {j}\n  snapshot_time: {s}\n" + (f"  open: {{ samples: {n} }}\n" if n is not None else "  close: { samples: 1 }\n") for p, j, s, n in counters if p == poll]
            path = folder / f"{poll:04}.raw"
            path.write_text(framed("h", "p", f"2024-01-01T{poll // 60:02}:{poll % 60:02}:00+00:00", "job_stats:\n" + "".join(jobs)))
            os.utime(path, (1_700_000_000 + poll, 1_700_000_000 + poll))
        flush(folder, "2024-01-02T00:00:00+00:00")
        merged = feed.stream_merge(stream_raw_log(spark, str(folder), 1), "0 seconds")
        handler = feed.KeyedRateFeed(str(tmp_path / "state"), {"t": feed.batch_table(str(tmp_path / "out"))})
        feed.writer(state.job_changes(merged, keep=keep), handler, str(tmp_path / "cp"), None).start().awaitTermination(300)
        found = spark.read.parquet(str(tmp_path / "out")).where("open IS NOT NULL").select("poll_ts", "job_id", "open").collect()
        return sorted(((r[0] - 1704067200) // 60, r[1], r[2]) for r in found)

    return run


def test_rate_cases(changes):
    huge = 2**53 + 1
    counters = [
        (0, "one", 100, 1000),
        (0, "two", 100, 1000), (1, "two", 105, 1500),
        (0, "three", 100, 1000), (1, "three", 110, 2000), (2, "three", 120, 2500),
        (0, "reset", 100, 1000), (1, "reset", 110, 500), (2, "reset", 120, 520),
        (0, "stuck", 100, 1000), (1, "stuck", 100, 2000), (2, "stuck", 110, 2100),
        (0, "away", 100, 1000), (2, "away", 110, 2000), (3, "away", 120, 3000),
        (0, "gone", 100, 1000), (1, "gone", 110, None), (2, "gone", 120, 7),
        (1, "exact", 110, huge), (2, "exact", 111, 2 * huge),
    ]
    assert changes(counters) == sorted([
        (1, "two", 100), (1, "three", 100), (2, "three", 50), (1, "reset", 0), (2, "reset", 2),
        (2, "stuck", 10), (3, "away", 100), (1, "gone", 0), (2, "exact", huge),
    ])


def test_state_of_jobs_that_went_is_dropped(spark, changes, tmp_path):
    counters = [(0, "old", 100, 1), (0, "new", 100, 1), (1, "new", 110, 11), (300, "new", 200, 101), (301, "new", 210, 201)]
    assert changes(counters, keep=600) == [(1, "new", 1), (300, "new", 1), (301, "new", 10)]
    operators = spark.read.format("state-metadata").load(str(tmp_path / "cp"))
    ours = operators.where("operatorName LIKE 'transformWithState%'").first()["operatorId"]
    known = spark.read.format("statestore").option("operatorId", ours).option("stateVarName", "last").load(str(tmp_path / "cp"))
    assert known.count() == 0  # a day later


def retained(spark, folder, base, out, window, count):
    query = feed.live_series(spark, str(folder), base, feed.batch_table(out), window, count, "5 seconds", None)
    assert query.awaitTermination(300) and query.exception() is None
    return state.held(spark, f"{base}/checkpoint")


def expected_points(spark, folder, window, count):
    blocks = read_raw_log(spark, str(folder))
    watermark = blocks.select(F.max(F.unix_millis("poll_time"))).first()[0] - 5000
    table = merge.job_table(parse_job_stats(blocks)).where(F.unix_millis("poll_time") <= watermark)
    points = merge.to_long(table).select(F.col("poll_ts").alias("timestamp"), "job_id", "operation", "value")
    return points, series.cap_series(filters.prune_before(points, filters.live_cutoff(watermark // 1000, window)), count)


POINT = ["timestamp", "job_id", "operation", "value"]


@pytest.mark.parametrize(("window", "count"), [(1000, 3), (30, 4)])
def test_retained_points(spark, rows, tmp_path, window, count):
    folder, base, out = tmp_path / "logs", str(tmp_path / "run"), str(tmp_path / "gone")
    folder.mkdir()

    def arrive(polls):
        for poll in polls:
            for host in range(2):
                path = folder / f"{poll:03}-{host}.raw"
                path.write_text(log_of(poll, host))
                os.utime(path, (1_700_000_000 + poll, 1_700_000_000 + poll))

    def check():
        found = retained(spark, folder, base, out, window, count)
        everything, expected = expected_points(spark, folder, window, count)
        assert rows(found, *POINT) == rows(expected, *POINT)
        # What is not held has left, once.
        gone = spark.read.parquet(out).drop("batch_id")
        assert rows(gone.unionByName(found.withColumn("why", F.lit(""))), *POINT) == rows(everything, *POINT)
        return found.count()

    arrive(range(7))
    assert check() > 0
    arrive(range(7, POLLS))
    assert check() > 0  # after a restart
    if window == 30:
        flush(folder, "2024-01-01T10:00:00+00:00")
        assert check() == 0  # nothing is young enough any more


def test_a_session_with_other_state_is_refused(spark, tmp_path):
    merged = feed.stream_merge(stream_raw_log(spark, str(tmp_path)))
    spark.conf.unset(STATE_STORE)
    try:
        with pytest.raises(RuntimeError, match="RocksDB"):
            state.job_changes(merged)
    finally:
        spark.conf.set(STATE_STORE, ROCKSDB)
    with pytest.raises(ValueError):
        state.retain(feed.point_stream(merged), 0, 10)
    with pytest.raises(ValueError):
        state.job_changes(merged, "average")


def test_live_rates_with_keyed_state_and_with_counters(spark, rows, shuffled, tmp_path):
    flush(shuffled)
    expected = rates.job_rates(batch_table(spark, str(shuffled)))
    out, kept = str(tmp_path / "rates"), str(tmp_path / "counters")
    query = feed.live_rates(spark, str(shuffled), str(tmp_path / "a"), {"t": feed.batch_table(out)}, delay="1 second", interval=None, keyed=True)
    assert query.awaitTermination(300)
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected, *COLUMNS)
    query = feed.live_rates(
        spark, str(shuffled), str(tmp_path / "b"), {"t": feed.batch_table(out)}, delay="1 second", interval=None, counters={"c": feed.batch_table(kept)}
    )
    assert query.awaitTermination(300)
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected, *COLUMNS)
    columns = ["poll_ts", "job_id", "snapshot_time", "ops", "open"]
    assert rows(spark.read.parquet(kept), *columns) == rows(batch_table(spark, str(shuffled)).where("job_id IS NOT NULL"), *columns)
    with pytest.raises(ValueError, match="share the names"):
        feed.RateFeed("x", {"t": print}, counters={"t": print})
