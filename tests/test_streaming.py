"""Streams over framed logs give what the batch operators give."""

import os

import pytest
from conftest import framed
from pyspark.sql import functions as F

from jobtally.functions.layout import JobIdLayout
from jobtally.operators import merge, rates
from jobtally.session import shared_dir
from jobtally.sinks.peaks import PeakStore
from jobtally.sinks.points import SinksFailed, write_points_parquet
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.points import load_points
from jobtally.sources.raw_log import read_raw_log, stream_raw_log
from jobtally.streaming import feed

POLLS = 12


def dump(poll, host):
    if poll == 6:
        return "job_stats:\n"
    jobs = [job for job in range(5) if (poll + job) % 4]
    return "job_stats:\n" + "".join(
        f"- job_id:  j{job}\n  snapshot_time: {1000 + 10 * poll + host}\n  open: {{ samples: {poll * (job + 1) * 20 + host + 1} }}\n"
        for job in jobs
    )


def log_of(poll, host):
    time = f"2024-01-01T00:{poll // 6:02}:{poll % 6 * 10:02}.5+00:00"
    return framed(f"oss{host}", f"obdfilter.t{host}.job_stats", time, dump(poll, host))


@pytest.fixture
def logs(tmp_path):
    """One file per poll and host, so that a poll arrives in pieces."""
    folder = tmp_path / "logs"
    folder.mkdir()
    for poll in range(POLLS):
        for host in range(2):
            path = folder / f"{poll:03}-{host}.raw"
            path.write_text(log_of(poll, host))
            at = 1_700_000_000 + 2 * poll + host  # files are taken in this order; those of one moment in any
            os.utime(path, (at, at))
    return folder


def batch_table(spark, path):
    blocks = read_raw_log(spark, path)
    table = merge.job_table(parse_job_stats(blocks).drop("poll_time"))
    return merge.with_poll_numbers(table, merge.poll_register(blocks))


def run(spark, logs, sinks, base, files_per_batch=9):
    blocks = stream_raw_log(spark, str(logs), files_per_batch)
    rate_feed = feed.RateFeed(f"{base}/state", sinks)
    query = feed.writer(feed.stream_merge(blocks, "5 seconds"), rate_feed, f"{base}/checkpoint", None).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return rate_feed


COLUMNS = ["poll_ts", "job_id", "sampling_window", "ops", "open"]


def test_stream_rates_equal_batch_rates(spark, rows, logs, tmp_path):
    base, out = str(tmp_path / "run"), str(tmp_path / "rates")
    sinks = {
        "table": feed.batch_table(out),
        "peaks": feed.peak_store(f"{base}/peaks"),
        "points": feed.long_points(write_points_parquet, f"{base}/points.parquet"),
    }
    rate_feed = run(spark, logs, sinks, base)
    assert rate_feed.failed == {}
    expected = rates.job_rates(batch_table(spark, str(logs)))
    last = expected.agg(F.max("poll_ts")).first()[0]
    # The watermark is still waiting for the newest poll.
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected.where(F.col("poll_ts") < last), *COLUMNS)
    # One more poll releases it; the stream goes on from its stored reference.
    (logs / "999-0.raw").write_text(framed("oss0", "p", "2024-01-01T00:05:00+00:00", "job_stats:\n"))
    run(spark, logs, sinks, base)
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected, *COLUMNS)
    ops, jobs = PeakStore(f"{base}/peaks").read(spark)
    best = rows(expected.groupBy("poll_ts").agg(F.sum("open").alias("v")).agg(F.max("v")))[0][0]
    assert rows(ops.where("operation = 'open'"), "rate") == [(best,)]
    assert jobs.where("operation = 'open'").count() == 1
    long = load_points(spark, f"{base}/points.parquet")
    assert long.where("operation = 'open'").count() == expected.where("open IS NOT NULL").count()


def test_a_batch_run_twice_changes_nothing(spark, rows, logs, tmp_path):
    table = merge.job_table(parse_job_stats(read_raw_log(spark, str(logs)), keep_empty=True))
    times = sorted(t for t, in rows(table.select("poll_ts").distinct()))
    out = str(tmp_path / "rates")
    rate_feed = feed.RateFeed(str(tmp_path / "state"), {"t": feed.batch_table(out)})
    halves = [table.where(F.col("poll_ts") <= times[4]), table.where(F.col("poll_ts") > times[4])]
    assert not rate_feed.has_reference(spark, 0)
    rate_feed(halves[0], 0)
    rate_feed(halves[1], 1)
    rate_feed(halves[1], 1)
    expected = rates.job_rates(batch_table(spark, str(logs)))
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected, *COLUMNS)
    assert rate_feed.has_reference(spark, 1)
    rate_feed.reset(spark, 1)
    assert not rate_feed.has_reference(spark, 1)
    rate_feed(halves[1], 1)
    between = expected.where(F.col("poll_ts") == times[5])
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected.subtract(between), *COLUMNS)


def test_an_empty_batch_keeps_the_reference(spark, rows, logs, tmp_path):
    table = merge.job_table(parse_job_stats(read_raw_log(spark, str(logs)), keep_empty=True))
    rate_feed = feed.RateFeed(str(tmp_path / "state"), {})
    rate_feed(table, 0)
    before = rows(rate_feed.reference(spark, 1))
    rate_feed(table.where("false"), 1)
    assert rows(rate_feed.reference(spark, 2)) == before != []


def test_a_failing_sink_is_reported(spark, logs, tmp_path):
    def broken(df, batch_id):
        raise OSError("no space")

    out = str(tmp_path / "rates")
    table = merge.job_table(parse_job_stats(read_raw_log(spark, str(logs))))
    rate_feed = feed.RateFeed(str(tmp_path / "state"), {"bad": broken, "good": feed.batch_table(out)}, go_on=True)
    rate_feed(table, 0)
    assert list(rate_feed.failed) == ["bad"] and spark.read.parquet(out).count() > 0
    strict = feed.RateFeed(str(tmp_path / "strict"), {"bad": broken, "good": feed.batch_table(out)})
    with pytest.raises(SinksFailed, match="no space"):
        strict(table, 0)
    assert not strict.has_reference(spark, 1)  # the batch is not over and will be run again
    with pytest.raises(SinksFailed):
        feed.every_batch({"bad": broken})(table, 0)
    feed.every_batch({"bad": broken}, go_on=True)(table, 0)


def test_a_batch_run_twice_stores_its_points_once(spark, logs, tmp_path):
    table = merge.job_table(parse_job_stats(read_raw_log(spark, str(logs))))
    sink = feed.long_points(write_points_parquet, str(tmp_path / "p.parquet"))
    for batch_id in (0, 0, 1):
        sink(table.where(F.col("poll_ts") % 2 == batch_id), batch_id)
    assert load_points(spark, str(tmp_path / "p.parquet")).count() == merge.to_long(table).count()


def test_merged_polls_go_to_every_sink(spark, rows, logs, tmp_path):
    base = str(tmp_path)
    blocks = stream_raw_log(spark, str(logs))
    write = feed.every_batch({"a": feed.batch_table(f"{base}/a"), "b": feed.batch_table(f"{base}/b")})
    feed.writer(feed.stream_merge(blocks, "1 second"), write, f"{base}/c", None).start().awaitTermination(120)
    columns = ["poll_ts", "job_id", "snapshot_time", "open"]
    expected = batch_table(spark, str(logs)).where(F.col("poll") < POLLS - 1)
    found = spark.read.parquet(f"{base}/a").where("job_id IS NOT NULL")
    assert rows(found, *columns) == rows(expected, *columns)
    assert spark.read.parquet(f"{base}/b").count() == spark.read.parquet(f"{base}/a").count()


def test_a_number_of_batches(spark, logs, tmp_path):
    blocks = stream_raw_log(spark, str(logs), 4)
    query = feed.writer(feed.stream_merge(blocks), feed.batch_table(str(tmp_path / "o")), str(tmp_path / "c"), 0).start()
    feed.run_batches(query, 2)
    assert not query.isActive
    assert feed.repeats_needed(1, "rate") == 2 and feed.repeats_needed(1, "counter") == 1 and feed.repeats_needed(-1, "diff") == -1


def test_shared_folder_is_the_one_the_cluster_names(spark, tmp_path):
    class Session:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": "/shared/cp/"}.get(key, default))

    assert shared_dir(Session) == "/shared/cp"
    made = shared_dir(spark)
    assert made and shared_dir(spark) == made


def test_live_view(spark, rows, logs, tmp_path):
    out = str(tmp_path / "rates")
    query = feed.live_rates(
        spark, str(logs), str(tmp_path / "live"), {"t": feed.batch_table(out)}, "diff", "1 second", None,
        JobIdLayout.parse("%j.%u"), "job",
    )
    query.awaitTermination(120)
    expected = rates.job_rates(batch_table(spark, str(logs)), "diff").where(F.col("poll") < POLLS - 1)
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(expected, *COLUMNS)
