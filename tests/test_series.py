"""Series and replay: known cases, random points against brute force, long series."""

import random

import pytest

from jobtally.functions import vocabulary
from jobtally.operators import bars, filters, replay, series, topn
from jobtally.operators.skew import beside

POINTS = "timestamp BIGINT, job_id STRING, operation STRING, value BIGINT"


def one_series(spark, pairs):
    return spark.createDataFrame([(t, "j", "read", v) for t, v in pairs], POINTS)


@pytest.mark.parametrize(
    "pairs, expected",
    [
        ([(7, 3)], []),
        ([], []),
        ([(40, 12), (44, 30), (47, 31), (60, 31)], [(44, 4), (47, 0), (60, 0)]),
        ([(40, 90), (41, 8), (48, 64)], [(41, 0), (48, 8)]),
        ([(-5, 1), (4, 73)], [(4, 8)]),
    ],
)
def test_rate_of_a_series(spark, rows, pairs, expected):
    assert rows(series.series_rate(one_series(spark, pairs)), "timestamp", "value") == expected


def random_points(seed, count=400):
    pick = random.Random(seed)
    seen = {}
    for _ in range(count):
        job = "hot" if pick.random() < 0.5 else f"j{pick.randrange(4)}"
        seen[pick.randrange(100, 1300), job, pick.choice(["open", "read"])] = pick.randrange(5000)
    return [(*key, value) for key, value in seen.items()]


def by_series(points):
    out = {}
    for t, job, op, value in sorted(points):
        out.setdefault((job, op), []).append((t, value))
    return out


@pytest.mark.parametrize("chunk", [7, 100, 86400])
@pytest.mark.parametrize("forward", [False, True])
def test_neighbours_cross_chunks(spark, rows, chunk, forward):
    points = random_points(4)
    found = beside(spark.createDataFrame(points, POINTS), ["job_id", "operation"], forward, chunk)
    expected = []
    for key, line in by_series(points).items():
        for i, (t, v) in enumerate(line):
            at = i + 1 if forward else i - 1
            expected.append((*key, t, v, line[at] if 0 <= at < len(line) else None))
    got = [(r.job_id, r.operation, r.timestamp, r.value, tuple(r.beside) if r.beside else None) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_one_shuffle_feeds_points_and_edges(spark, tmp_path):
    spark.range(1000).selectExpr("id AS timestamp", "'j' AS job_id", "'read' AS operation", "id AS value").write.parquet(
        str(tmp_path / "p")
    )
    rate = series.series_rate(spark.read.parquet(str(tmp_path / "p")))
    assert rate.count() == 999
    rate.collect()
    plan = rate._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 + plan.count("ReusedExchange")
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("step, start, end", [(25, None, None), (40, 300, 1000), (7, 0, 2000)])
def test_frames_against_brute_force(spark, rows, step, start, end):
    points = random_points(8)
    times = [p[0] for p in points]
    low, high = min(times) if start is None else start, max(times) if end is None else end
    expected = []
    for key, line in by_series(points).items():
        for frame in range(low, high + 1, step):
            past = [v for t, v in line if t <= frame]
            if past:
                expected.append((frame, *key, past[-1]))
    found = replay.replay_frames(spark.createDataFrame(points, POINTS), step, low, high)
    assert rows(found, "frame", "job_id", "operation", "value") == sorted(expected, key=repr)


def test_state_at(spark, rows):
    points = random_points(3)
    expected = []
    for key, line in by_series(points).items():
        past = [(t, v) for t, v in line if t <= 600]
        if past:
            expected.append((*key, past[-1][1], past[-1][0]))
    found = replay.state_at(spark.createDataFrame(points, POINTS), 600)
    assert rows(found, "job_id", "operation", "value", "timestamp") == sorted(expected, key=repr)


def test_downsample(spark, rows):
    points = random_points(5)
    inside = [p for p in points if 200 <= p[0] <= 900]
    buckets = {}
    for t, job, op, value in sorted(inside):
        buckets[(t - 200) // (700 // 9), job, op] = (t, job, op, value)
    frame = spark.createDataFrame(points, POINTS)
    columns = ["timestamp", "job_id", "operation", "value"]
    assert rows(replay.downsample(frame, 200, 900, 9), *columns) == sorted(buckets.values(), key=repr)
    assert rows(replay.downsample(frame, 200, 900, 10000), *columns) == sorted(inside, key=repr)
    # More moments than seconds: buckets are never shorter than a second.
    assert replay.downsample(frame, 200, 203, 2).count() <= len([p for p in points if 200 <= p[0] <= 203])
    with pytest.raises(ValueError):
        replay.downsample(frame, 0, 1, 0)


def test_cap_keeps_the_newest(spark, rows):
    points = random_points(6)
    expected = [(t, *key, v) for key, line in by_series(points).items() for t, v in line[-5:]]
    capped = series.cap_series(spark.createDataFrame(points, POINTS), 5)
    assert rows(capped, "timestamp", "job_id", "operation", "value") == sorted(expected, key=repr)
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


def test_latest_rate(spark, rows):
    points = [(100, "a", "read", 5), (130, "a", "read", 65), (150, "a", "read", 25), (160, "b", "read", 9), (40, "b", "read", 1)]
    frame = spark.createDataFrame(points, POINTS)
    assert rows(series.latest_rate(frame, 150), "job_id", "value") == [("a", 0)]
    assert rows(series.latest_rate(frame, 130), "job_id", "value") == [("a", 2)]
    assert rows(series.latest_rate(frame, 160), "job_id", "value") == [("a", 0), ("b", 0)]
    assert rows(series.latest_op_rate(frame, ["read", "open"], 130), "operation", "value") == [("open", 0), ("read", 2)]


def test_job_views(spark, rows):
    points = [(1, "a", "read", 5), (1, "a", "read", 5), (1, "a", "open", 2), (2, "a", "read", 7), (2, "b", "read", 1), (3, "b", "sync", 4)]
    frame = spark.createDataFrame(points, POINTS)
    assert rows(series.job_series(frame, "a", ["read", "open"], 1)) == [(1, 7), (2, 7)]
    assert rows(series.unique_points(frame).where("job_id = 'a' AND timestamp = 1"), "operation", "value") == [("open", 2), ("read", 5)]
    assert rows(series.op_series(series.unique_points(frame), "read"), "timestamp", "value") == [(1, 5), (2, 8)]
    assert rows(series.jobs_with_ops(frame, ["open", "sync"], 2)) == [("b",)]
    assert series.has_job(frame, "b").count() == 1 and series.has_job(frame, "c").count() == 0
    assert rows(series.time_range(frame)) == [(1, 3)]
    assert [r.job_id for r in series.catalog_jobs(frame).collect()] == ["a", "b"]
    assert [r.operation for r in series.catalog_ops(frame).collect()] == ["open", "read", "sync"]
    assert rows(series.axis(series.op_series(frame, "read"), 2), "x", "value") == [(0, 8)]
    assert rows(series.axis_max(frame)) == [(100,)]
    assert rows(filters.prune_before(frame, 3), "job_id") == [("b",)]
    assert filters.live_cutoff(1000, 300) == 400


def test_interactive_lists(spark, rows):
    ops = [("a.1", "read", 5), ("a.1", "sync", 50), ("a.2", "read", 9), ("b.1", "open", 9), ("b.2", "read", 0)]
    state = spark.createDataFrame(ops, "job_id STRING, operation STRING, value BIGINT")
    top = topn.top_jobs_filtered(state, count=2)
    assert [(r.job_id, r.total) for r in top.collect()] == [("a.2", 9), ("b.1", 9)]
    assert rows(topn.page(topn.top_jobs_filtered(state), 1, 5), "job_id", "total") == [("a.1", 5), ("b.1", 9)]
    with pytest.raises(ValueError):
        topn.top_jobs_filtered(state, count=0)
    visible = topn.visible_jobs(state, full="a.", selected=["a.1"], mode="exclusive")
    assert rows(topn.top_jobs_filtered(visible), "job_id", "total") == [("a.2", 9)]
    assert rows(bars.visible_op_totals(state, ["read", "open", "punch"])) == [("open", 9), ("punch", 0), ("read", 14)]
    assert rows(bars.top_job_bars(state, top, ["read", "open"])) == [
        ("a.2", "open", 0), ("a.2", "read", 9), ("b.1", "open", 9), ("b.1", "read", 0),
    ]
    assert rows(topn.job_columns(state, ["read", "open"], shown=["read"])) == [("a.1", 5, 5), ("a.2", 9, 9), ("b.1", 9, 0)]
    assert topn.job_columns(state).columns[2:] == list(vocabulary.DEFAULT_OPERATIONS)


def test_lists_of_every_poll(spark, rows):
    ops = [(p, f"j{j:03}", "read", 1000 * p + j) for p in (1, 2) for j in range(120)] + [(2, "late", "sync", 5)]
    states = spark.createDataFrame(ops, "poll BIGINT, job_id STRING, operation STRING, value BIGINT")
    top = topn.top_jobs_filtered(states, count=100)
    assert rows(top.groupBy("poll").count()) == [(1, 100), (2, 100)]
    assert top.where("rank = 1").orderBy("poll").select("poll", "job_id", "total").collect() == [(1, "j119", 1119), (2, "j119", 2119)]
    assert rows(topn.page(top, 2, 1), "poll", "job_id") == [(1, "j117"), (2, "j117")]
    assert rows(topn.latest(top).select("poll").distinct()) == [(2,)]
    totals = bars.visible_op_totals(states, ["read", "open"])
    assert rows(totals.where("operation = 'read'"), "poll", "value") == [(1, 127140), (2, 247140)]
    assert topn.job_columns(states, ["read"]).where("job_id = 'j001'").count() == 2


def test_bars_keep_top_jobs_without_values(spark, rows):
    top = spark.createDataFrame([("a",), ("gone",)], "job_id STRING")
    points = spark.createDataFrame([(10, "a", "read", 5), (20, "a", "read", 45), (20, "b", "read", 1)], POINTS)
    state = points.where("timestamp = 20").drop("timestamp")
    assert rows(bars.top_job_bars(state, top, ["read"])) == [("a", "read", 45), ("gone", "read", 0)]
    assert rows(bars.top_job_rates(points, top, 20, enabled=["read"])) == [("a", "read", 4), ("gone", "read", 0)]
    assert rows(bars.top_job_rate_series(points, top, 0, ["read"]), "job_id", "timestamp", "value") == [("a", 20, 4)]


def test_frames_need_a_period_and_stay_in_it(spark, rows):
    points = spark.createDataFrame([(0, "j", "read", 1), (31_536_000, "j", "read", 2)], POINTS)
    assert rows(replay.replay_frames(points, 10, 100, 120), "frame", "value") == [(100, 1), (110, 1), (120, 1)]
    assert replay.replay_frames(points, 1, 50, 5049).count() == 5000
    assert rows(replay.replay_intervals(points), "from", "to", "value") == [(0, 31_536_000, 1), (31_536_000, None, 2)]
    with pytest.raises(ValueError):
        replay.replay_frames(points, 10, 5, 4)


def test_operations_of_any_name(spark, rows):
    """Metric names are free text: quotes, dots, spaces, names of columns."""
    from jobtally.operators import bars, topn

    names = ["we'ird", "a.b", "c d", "`q`", "job_id", "poll", "ünï"]
    states = spark.createDataFrame(
        [(1, job, name, 10 * n + k) for n, name in enumerate(names, 1) for k, job in enumerate(("x", "y"))], "poll long, job_id string, operation string, value long"
    )
    assert rows(bars.visible_op_totals(states, names)) == sorted(((1, name, 20 * n + 1) for n, name in enumerate(names, 1)), key=repr)
    top = states.select("poll", "job_id").distinct()
    assert rows(bars.top_job_bars(states, top, names)) == rows(states)
    quoted = topn.job_columns(states, names[:3])
    assert quoted.columns == ["poll", "job_id", "total", *names[:3]] and rows(quoted) == [(1, "x", 60, 10, 20, 30), (1, "y", 63, 11, 21, 31)]
    points = states.selectExpr("100L AS timestamp", "job_id", "operation", "value").unionByName(states.selectExpr("110L AS timestamp", "job_id", "operation", "value + 50 AS value"))
    assert rows(series.latest_op_rate(points, names, 120)) == sorted(((name, 10) for name in names), key=repr)
