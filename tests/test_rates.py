"""Rates against a plain re-statement of the rules on random polls."""

import random

import pytest

from jobtally.operators import merge, rates, shares, topn

NAMES = ["open", "read", "write"]


def random_polls(seed, polls=23, jobs=6):
    """Counters per poll with vanishing jobs and metrics, resets and an empty poll."""
    pick = random.Random(seed)
    counters = {}
    out = []
    for poll in range(polls):
        if poll == 11:
            continue
        for job in range(jobs):
            if pick.random() < 0.2:
                continue
            snapshot = 1000 + poll * 10 + (0 if pick.random() < 0.15 else pick.randrange(4))
            if pick.random() < 0.1:
                snapshot -= 40
            for name in NAMES:
                key = (job, name)
                counters[key] = 0 if pick.random() < 0.05 else counters.get(key, 0) + pick.randrange(60)
                if pick.random() < 0.8:
                    out.append((poll, 1000 + poll * 10, f"j{job}", snapshot, name, counters[key]))
    return out


SCHEMA = "poll BIGINT, poll_ts BIGINT, job_id STRING, snapshot_time BIGINT, operation STRING, samples BIGINT"


def expected(samples, mode):
    values, snaps = {}, {}
    for poll, _, job, snap, name, count in samples:
        snaps[poll, job] = max(snaps.get((poll, job), 0), snap)
        if count:
            for op in (name, "ops"):
                values[poll, job, op] = values.get((poll, job, op), 0) + count
    out = []
    for (poll, job, op), old in values.items():
        now = poll + 1
        if (now, job) not in snaps or snaps[now, job] <= snaps[poll, job]:
            continue
        grown = max(values.get((now, job, op), 0) - old, 0)
        out.append((now, job, op, grown // (snaps[now, job] - snaps[poll, job]) if mode == "rate" else grown))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("mode", ["rate", "diff"])
def test_rates_follow_the_rules(spark, rows, seed, mode):
    samples = random_polls(seed)
    table = merge.job_table(spark.createDataFrame(samples, SCHEMA))
    found = merge.to_long(rates.job_rates(table, mode, polls_per_chunk=4))
    assert rows(found, "poll", "job_id", "operation", "value") == expected(samples, mode)


def test_chunk_length_does_not_matter(spark, rows):
    table = merge.job_table(spark.createDataFrame(random_polls(9, polls=40), SCHEMA))
    results = [rows(rates.job_rates(table, polls_per_chunk=size)) for size in (2, 3, 7, 1024)]
    assert results[0] and all(found == results[0] for found in results)


def test_a_job_in_every_poll_spreads_over_chunks(spark):
    """One job holds nearly all rows: no window group exceeds a chunk."""
    samples = spark.range(5000).selectExpr(
        "id AS poll", "id * 10 AS poll_ts", "if(id % 50 = 0, concat('j', id), 'hot') AS job_id",
        "id * 10 AS snapshot_time", "'open' AS operation", "id * 3 + 1 AS samples",
    )
    found = rates.job_rates(merge.job_table(samples), polls_per_chunk=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    # 100 gaps: polls 0, 50, ... lack the hot job, so two pairs are lost at each.
    assert found.where("job_id = 'hot'").count() == 4999 - 2 * 99 - 1


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        rates.job_rates(merge.job_table(spark.createDataFrame([], SCHEMA)), "speed")


def test_jobs_that_used_nothing_have_a_window_but_no_rate(spark, rows):
    samples = spark.createDataFrame(
        [(p, p * 10, "idle", 100 + p * 10, "open", 0) for p in (0, 1)] + [(p, p * 10, "busy", 100 + p * 10, "open", 5 + p) for p in (0, 1)],
        SCHEMA,
    )
    found = rates.job_rates(merge.job_table(samples))
    assert rows(rates.sampling_windows(found), "job_id", "sampling_window") == [("busy", 10), ("idle", 10)]
    assert rows(rates.has_rates(found), "job_id", "ops") == [("busy", 0)]


def test_totals_and_percent_cover_all_jobs(spark, rows):
    ops = [(0, "a", "open", 30), (0, "b", "open", 10), (0, "b", "oddity", 7), (1, "a", "open", 0), (1, "a", "ops", 0)]
    job_ops = spark.createDataFrame(ops, "poll BIGINT, job_id STRING, operation STRING, value BIGINT")
    assert rows(shares.long_totals(job_ops)) == [(0, "open", 40), (1, "open", 0), (1, "ops", 0)]
    shown = [(0, "a", "open", 75), (0, "b", "oddity", 7), (0, "b", "open", 25), (1, "a", "open", 0), (1, "a", "ops", 0)]
    assert rows(shares.percent(job_ops)) == shown
    assert rows(shares.percent(job_ops, shares.long_totals(job_ops))) == shown


TABLE = "poll BIGINT, poll_ts BIGINT, job_id STRING, ops BIGINT, open BIGINT, write BIGINT"


def test_top_lists(spark, rows):
    data = [(0, 5, f"j{i}", i % 4 + 1, i, None if i % 2 else i) for i in range(8)] + [(1, 15, "j9", 3, 3, None)]
    table = spark.createDataFrame(data, TABLE)
    ids = lambda df: [(r.poll, r.rank, r.job_id) for r in df.orderBy("poll", "rank").collect()]
    assert ids(topn.top_jobs(table, count=3)) == [(0, 1, "j3"), (0, 2, "j7"), (0, 3, "j2"), (1, 1, "j9")]
    assert ids(topn.top_jobs(table, count=2, skip=3)) == [(0, 4, "j6"), (0, 5, "j1")]
    assert ids(topn.top_jobs(table, "write", count=2)) == [(0, 1, "j6"), (0, 2, "j2"), (1, 1, "j9")]
    assert ids(topn.top_jobs(table, count=9, min_rate=3)) == [(0, 1, "j3"), (0, 2, "j7")]
    assert ids(topn.top_jobs(table, count=9, patterns=["j1", "j3"], invert=True)) == [(0, 1, "j3"), (0, 2, "j1")]
    assert ids(topn.top_jobs(table, count=9, patterns=[], invert=True)) == []
    assert ids(topn.top_jobs_exact(table, ["j3", "j7", "j2", "j6"], count=2)) == [(0, 1, "j1"), (0, 2, "j5"), (1, 1, "j9")]
    single = table.drop("poll", "poll_ts")
    assert [(r.rank, r.job_id) for r in topn.top_jobs(single, count=2, skip=1).collect()] == [(2, "j7"), (3, "j2")]
    with pytest.raises(ValueError):
        topn.top_jobs(table, "samedir_rename")
    with pytest.raises(ValueError):
        topn.top_jobs(table, patterns=[""])


def test_idle_jobs_are_left_out_even_below_a_negative_bound(spark, rows):
    table = spark.createDataFrame([(0, 5, "idle", 0, 0, None), (0, 5, "busy", 0, 4, None)], TABLE)
    assert rows(topn.top_jobs(table, min_rate=-1), "job_id") == [("busy",)]
