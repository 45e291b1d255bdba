"""Report options and the lines of a report."""

import pytest

from jobtally.functions.layout import JobIdLayout
from jobtally.operators import merge
from jobtally.plans import report
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.raw_log import read_raw_log

T0 = 1704067200


@pytest.fixture
def inputs(spark, golden_log):
    blocks = read_raw_log(spark, golden_log)
    polls = merge.poll_register(blocks)
    return merge.with_poll_numbers(parse_job_stats(blocks).drop("poll_time"), polls), polls


def text(result, options, poll):
    lines = report.lines(result, options).where(f"poll = {poll}").orderBy("part", "pos")
    return [row.line for row in lines.collect()]


def test_counter_report(inputs):
    options = report.Options()
    assert text(report.build(*inputs, options), options, 0) == [
        "---",
        f"timestamp: {T0}",
        "servers_queried: 2",
        "osts_queried: 1",
        "mdts_queried: 1",
        "total_jobs: 2",
        "top_5_jobs:",
        "- cp.0.n2:          {ops: 14, ga: 14}",
        "- dd.0.n1:          {ops: 10, wr: 10}",
        "...",
    ]


def test_rate_report_with_totals(inputs):
    options = report.Options(mode="rate", total=True, fullname=True, human_time=True, width=4)
    result = report.build(*inputs, options)
    assert text(result, options, 0) == []
    assert text(result, options, 1) == [
        "---",
        "timestamp: Mon 01 Jan 2024 00-00-10 +0000",
        "query_duration: 10",
        "servers_queried: 1",
        "osts_queried: 1",
        "mdts_queried: 0",
        "total_jobs: 2",
        "top_5_job_operation_rates_during_query_windows:",
        "- dd.0.n1: {ops: 2, write: 2, sampling_window: 10}",
        "total_rate_per_operation_during_query_window:",
        "- ops:       {rate: 2}",
        "- write:     {rate: 2}",
        "...",
    ]


def test_percent_report_by_user_without_matches(inputs):
    options = report.Options(percent=True, groupby="user", count=3, patterns=("0",), include_bytes=True)
    result = report.build(*inputs, options, JobIdLayout.parse("%e.%u.%H"))
    lines = text(result, options, 0)
    assert "top_3_job_operations_in_percent_to_total_operations: []" in lines
    assert lines[-5:] == ["total_operations:", "- ops:       {rate: 30}", "- ga:        {rate: 14}", "- wr:        {rate: 10}", "- rb:        {rate: 6}"] or lines[-1] == "..."
    assert "- rb:        {rate: 6}" in lines


def test_difference_report(inputs):
    options = report.Options(mode="diff", sortby="write", min_rate=10)
    lines = text(report.build(*inputs, options), options, 1)
    assert lines[7:] == [
        "top_5_job_operation_difference_between_query_windows:",
        "- dd.0.n1:          {ops: 25, wr: 25, sw: 10}",
        "...",
    ]


def test_peaks_report(inputs):
    options = report.Options(peaks=True, mode="diff", percent=True)
    assert (options.mode, options.total, options.percent) == ("rate", True, False)
    result = report.build(*inputs, options)
    expected = [
        "highest_rate_per_operation_in_logfile:",
        f"- ops:       {{rate: 2,         ts: {T0 + 10}}}",
        f"- wr:        {{rate: 2,         ts: {T0 + 10}}}",
        "job_with_hightest_rate_per_operation_in_logfile:",
        f"- ops:       {{ops: 2, wr: 2, ts: {T0 + 10}, job_id: dd.0.n1}}",
        f"- wr:        {{ops: 2, wr: 2, ts: {T0 + 10}, job_id: dd.0.n1}}",
        "...",
    ]
    assert text(result, options, 1)[-8:] == ["- wr:        {rate: 2}", *expected]
    lines = report.peak_lines(result.peak_ops, result.peak_jobs, options).orderBy("part", "pos")
    assert [row.line for row in lines.collect()] == expected


def test_peaks_stand_as_they_were_after_each_poll(spark):
    """A poll without the operation keeps its peak; a job that comes later does not change earlier polls."""
    counts = {0: {"a": 0, "b": 0}, 1: {"a": 50, "b": 10}, 2: {"b": 10}, 3: {"a": 60, "b": 130}, 4: {"a": 60, "b": 140}}
    rows = [(n, T0 + 10 * n, "h", "mdt.x.job_stats", job, T0 + 10 * n, op, value + 1) for n, jobs in counts.items() for job, value in jobs.items() for op in (("open", "read") if n != 2 else ("open",))]
    samples = spark.createDataFrame(rows, "poll long, poll_ts long, host string, param string, job_id string, snapshot_time long, operation string, samples long")
    polls = samples.select("poll", "poll_ts").distinct()
    options = report.Options(peaks=True)
    result = report.build(samples, polls, options)
    held = lambda df, *columns: sorted(tuple(r) for r in df.where("operation = 'read'").select("poll", *columns).collect())
    assert held(result.running_ops, "rate", "timestamp") == [(1, 6, T0 + 10), (2, 6, T0 + 10), (3, 6, T0 + 10), (4, 6, T0 + 10)]
    assert held(result.running_jobs, "job_id", "rate") == [(1, "a", 5), (2, "a", 5), (3, "a", 5), (4, "a", 5)]
    assert text(result, options, 2)[-1] == "..." and any("job_id: a" in line for line in text(result, options, 2))


@pytest.mark.parametrize("bad", [{"mode": "speed"}, {"sortby": "samedir_rename"}])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        report.Options(**bad)


def test_grouping_needs_a_layout(inputs):
    with pytest.raises(ValueError):
        report.build(*inputs, report.Options(groupby="user"))
