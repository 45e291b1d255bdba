"""Framed logs and dumps: the golden log, odd text, and the flat dialect."""

import pytest
from conftest import POLL_1, TIME_1, framed

from jobtally.functions.layout import JobIdLayout
from jobtally.operators import merge, rates
from jobtally.plans import derived
from jobtally.sources.dumps import parse_flat_blocks, parse_histogram, parse_job_stats
from jobtally.sources.raw_log import read_raw_log

T0 = 1704067200


def parsed(spark, text):
    return parse_job_stats(spark.createDataFrame([(T0, text)], "poll_ts BIGINT, data STRING"))


def test_blocks_of_the_golden_log(spark, rows, golden_log):
    blocks = read_raw_log(spark, golden_log)
    assert rows(blocks, "host", "param", "poll_ts") == [
        ("mds1", "mdt.x.job_stats", T0),
        ("oss1", "obdfilter.x.job_stats", T0),
        ("oss1", "obdfilter.x.job_stats", T0 + 10),
    ]
    assert {row.data for row in blocks.where("host = 'mds1'").collect()} == {POLL_1}


def test_blocks_that_are_not_whole_are_skipped(spark, rows, tmp_path):
    text = (
        framed("a", "p", "not a time", POLL_1)
        + framed("b", "p", "2024-01-01T00:00:00", POLL_1)
        + "### HOST: c | PARAM: p | TIMESTAMP: 2024-01-01T00:00:00Z ###\n" + POLL_1
        + "\n" + framed("d", "p", "2024-01-01T02:00:00+02:00", "job_stats:\n")
        + framed("e", "p", "2024-01-01T00:00:05Z", "")
        + "### HOST: f | PARAM: p | TIMESTAMP: 2024-01-01T00:00:00Z ###\n" + POLL_1
    )
    path = tmp_path / "odd.raw"
    path.write_text(text)
    blocks = read_raw_log(spark, str(path))
    assert rows(blocks, "host", "poll_ts") == [("d", T0), ("e", T0 + 5)]
    assert parse_job_stats(blocks).count() == 0
    assert parse_job_stats(blocks, keep_empty=True).count() == 2


def test_metrics_of_the_golden_log(spark, rows, golden_log):
    samples = parse_job_stats(read_raw_log(spark, golden_log)).where("host = 'mds1'")
    found = rows(samples, "job_id", "snapshot_time", "start_time", "elapsed_time", "operation", "samples", "unit", "min", "max", "sum", "hist")
    assert found == [
        ("cp.0.n2", 1700000011, 0, 0, "getattr", 7, "reqs", 0, 0, 0, {}),
        ("dd.0.n1", 1700000010, 1700000000, 10, "open", 0, "usecs", 0, 0, 0, {}),
        ("dd.0.n1", 1700000010, 1700000000, 10, "read_bytes", 3, "bytes", 4096, 4194304, 9000, {"4K": 1, "4M": 2}),
        ("dd.0.n1", 1700000010, 1700000000, 10, "write", 5, "usecs", 1, 9, 20, {}),
    ]
    assert rows(parse_histogram(samples), "operation", "bucket", "count") == [("read_bytes", "4K", 1), ("read_bytes", "4M", 2)]


def test_odd_lines(spark, rows):
    text = (
        "open: { samples: 99 }\n"  # before any job
        "- job_id: a\n"
        "  snapshot_time:7\n"  # no blank after the key
        "  snapshot_time: 5\n  snapshot_time: x\n  start_time: 12abc\n"
        "  open: { samples: x, unit: reqs }\n"
        "  close: { samples: 1 }\n  read: { samples: 3, samples: 4, min: 2 }\n  close: { samples: 2 }\n"
        "  punch: { samples: 8, hist: none }\n"
        "  statfs: { samples: 6, hist: { 1K: 5, 2K: x, 1K: 7 }, sum: 9 }\n"
        "  mkdir: { samples: 6\n"
        "  note_snapshot_time: { samples: 1 }\n"
        "\t- job_id:   b c  \r\n"
        "- job_id: d\n  elapsed_time: -3.5\r\n  write:: { samples: -2 }\r\n"
    )
    found = rows(parsed(spark, text), "job_id", "snapshot_time", "start_time", "elapsed_time", "operation", "samples", "min", "sum", "hist")
    assert found == [
        ("a", 5, 0, 0, "close", 2, 0, 0, {}),
        ("a", 5, 0, 0, "open", 0, 0, 0, {}),
        ("a", 5, 0, 0, "punch", 0, 0, 0, {}),
        ("a", 5, 0, 0, "read", 4, 2, 0, {}),
        ("a", 5, 0, 0, "statfs", 6, 0, 0, {"1K": 7}),
        ("b c", 0, 0, 0, None, 0, 0, 0, {}),
        ("d", 0, 0, -3, "write", -2, 0, 0, {}),
    ]


def test_times_after_the_first_metric_count(spark, rows):
    text = "- job_id: a\n  open: { samples: 1 }\n  snapshot_time: 42.9\n"
    assert rows(parsed(spark, text), "snapshot_time", "operation") == [(42, "open")]


def test_merge_of_the_golden_log(spark, rows, golden_log):
    samples = parse_job_stats(read_raw_log(spark, golden_log)).drop("poll_time")
    first = f"poll_ts = {T0}"
    assert rows(merge.merge_jobs(samples).where(first), "job_id", "operation", "value") == [
        ("cp.0.n2", "getattr", 14), ("cp.0.n2", "ops", 14), ("dd.0.n1", "ops", 10), ("dd.0.n1", "write", 10),
    ]
    with_bytes = merge.merge_jobs(samples, include_bytes=True).where(first).where("job_id = 'dd.0.n1'")
    assert rows(with_bytes, "operation", "value") == [("ops", 16), ("read_bytes", 6), ("write", 10)]
    assert rows(merge.job_times(samples).where(first), "job_id", *merge.TIMES) == [
        ("cp.0.n2", 1700000011, 0, 0), ("dd.0.n1", 1700000010, 1700000000, 10),
    ]
    by_user = merge.merge_jobs(samples, JobIdLayout.parse("%e.%u.%H"), "user").where(first)
    assert rows(by_user, "job_id", "operation", "value") == [('"0"', "getattr", 14), ('"0"', "ops", 24), ('"0"', "write", 10)]
    wide = merge.to_long(merge.job_table(samples))
    assert rows(wide, "poll_ts", "job_id", "operation", "value") == rows(
        merge.merge_jobs(samples), "poll_ts", "job_id", "operation", "value"
    )


def test_rates_of_the_golden_log(spark, rows, golden_log):
    blocks = read_raw_log(spark, golden_log)
    table = merge.with_poll_numbers(merge.job_table(parse_job_stats(blocks).drop("poll_time")), merge.poll_register(blocks))
    assert rows(rates.rates(table), "poll", "job_id", "operation", "value") == [(1, "dd.0.n1", "ops", 2), (1, "dd.0.n1", "write", 2)]
    assert rows(rates.rates(table, "diff"), "operation", "value") == [("ops", 25), ("write", 25)]
    assert rows(rates.job_rates(table), "sampling_window", "query_duration") == [(10, 10)]


def test_a_metric_named_like_the_total_is_not_counted(spark, rows):
    samples = parsed(spark, "- job_id: a\n ops: { samples: 5 }\n open: { samples: 2 }\n")
    assert rows(merge.merge_jobs(samples), "operation", "value") == [("open", 2), ("ops", 2)]
    assert rows(merge.to_long(merge.job_table(samples)), "operation", "value") == [("open", 2), ("ops", 2)]


def test_flat_dialect(spark, rows):
    text = (
        "open: 1\njob_id: a:b\n  snapshot_time: 9\n  open: 5\n  read: { samples: 7, unit: reqs }\n"
        "  two words: 3\n  write: 4.5\n  close: { unit: reqs }\n : 3\njob_id: c\n  mkdir: -2\n- job_id: d\n"
    )
    blocks = spark.createDataFrame([(T0, text)], "poll_ts BIGINT, data STRING")
    assert rows(parse_flat_blocks(blocks), "timestamp", "job_id", "operation", "value") == [
        (T0, "a:b", "open", 5), (T0, "a:b", "read", 7), (T0, "c", "mkdir", -2),
    ]


def test_poll_numbers_run_over_days(spark, rows):
    times = [T0 + 86400 * day + 10 * poll for day in (0, 1, 5) for poll in range(3)]
    blocks = spark.createDataFrame([(t,) for t in reversed(times)] + [(times[0],)], "poll_ts BIGINT")
    assert rows(merge.poll_register(blocks)) == list(enumerate(times))


def test_scopes(spark, rows):
    samples = spark.createDataFrame(
        [("a", "obdfilter.fs-OST0000.job_stats"), ("a", "mdt.fs-MDT0000.job_stats"), ("b", "mdt.fs_MDT0000.job_stats")],
        "host STRING, param STRING",
    )
    assert rows(merge.scope_sources(samples, ost=True), "host") == [("a",)]
    assert rows(merge.scope_sources(samples, mdt=True), "host") == [("a",), ("b",)]
    assert rows(merge.scope_sources(samples, servers=["b"]), "host") == [("b",)]
    assert rows(merge.scope_sources(samples, param="mdt.fs-MDT000?.job_stats"), "host") == [("a",)]
    assert rows(merge.scope_sources(samples, param="mdt.fs_*"), "host") == [("b",)]
    assert rows(merge.scope_sources(samples, param="mdt.fs-MDT000[0-3].job_stats"), "host") == [("a",)]
    assert rows(merge.scope_sources(samples, param="mdt.fs-MDT000[!0-3].job_stats"), "host") == []
    for glob in ("mdt.[0-3", "{mdt,ost}.*"):
        with pytest.raises(ValueError):
            merge.scope_sources(samples, param=glob)


def test_globs_against_the_standard_library():
    import fnmatch
    import re

    texts = ["a", "ab", "a.b", "a-b", "a]b", "a\\b", "x1y", "x9y", "a\nb", "a^b", "a&&b"]
    for glob in ("*", "?", "a?b", "a.b", "x[0-5]y", "x[!0-5]y", "a[.-]b", "a[]]b", "a*", "a[^x]b", "a[&&]*"):
        if glob != "a[^x]b":  # this library takes ^ like !, the standard one as a character
            assert [bool(re.match(merge.glob_pattern(glob).replace("\\z", "\\Z"), t)) for t in texts] == [fnmatch.fnmatchcase(t, glob) for t in texts], glob


def test_repeats_behind_tabs_and_blank_lines(spark, rows):
    dump = "job_stats:\n- job_id: j\n  snapshot_time: 5\n  open: { samples: 3 }\n\n\n\topen: { samples: 4 }\n  sync:{ samples: 1 }\n"
    blocks = spark.createDataFrame([("h", "p", 1, dump)], "host STRING, param STRING, poll_ts BIGINT, data STRING")
    assert rows(parse_job_stats(blocks), "operation", "samples") == [("open", 4), ("sync", 1)]


def test_header_time_is_kept_to_microseconds(spark, golden_log):
    first = read_raw_log(spark, golden_log).selectExpr("unix_micros(poll_time) AS t").agg({"t": "min"}).first()[0]
    assert first == T0 * 1000000 + 123456
    assert TIME_1.endswith("789+00:00")


def test_a_histogram_is_worked_out_once(spark):
    blocks = spark.createDataFrame([(T0, POLL_1)], "poll_ts BIGINT, data STRING")
    plan = parse_histogram(parse_job_stats(blocks))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(_hist#") == 1


def test_a_block_is_cut_once(spark):
    blocks = spark.createDataFrame([(T0, POLL_1)], "poll_ts BIGINT, data STRING")
    plan = parse_job_stats(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("- job_id:") == 1


def test_jobs_of_dumps_move_once(spark):
    """By series, by job while a series is a row, and by page; not for each metric, nor to put a job together. The list of polls is one more."""
    for build, moves in ((derived.dumps, 4), (derived.messy_dumps, 3)):
        plan = build(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(user_id") == 2 and plan.count("Exchange hashpartitioning(") == moves
