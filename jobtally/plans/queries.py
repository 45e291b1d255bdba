"""The registered queries: each runs an operator over the whole derived counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtally.functions import display, formats, vocabulary
from jobtally.operators import bars, filters, merge, patterns, peaks, rates, replay, series, shares, snapshots, topn
from jobtally.plans import derived, report
from jobtally.session import shared_dir
from jobtally.sinks.points import victoriametrics_lines, write_log_store, write_raw_log
from jobtally.sources import dumps, large_dumps, raw_log

Query = Callable[[SparkSession, str], DataFrame]

START = derived.POLL_ZERO
END = derived.POLL_ZERO + 290
JOB = "exe1.1.n1"
IDS = ["exe1.1.n1", "exe0.8.n8"]
PATTERNS = ["exe1", ".3."]
PIVOT_OPS = ["open", "read", "write", "close", "getattr", "setattr"]

_REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    _REGISTRY[build.__name__] = build
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


# Inputs shared by the queries.


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return merge.job_table(derived.samples(spark, sf))


def _rates(spark: SparkSession, sf: str, mode: str = "rate") -> DataFrame:
    return rates.job_rates(_table(spark, sf), mode)


def _job_ops(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_jobs(derived.samples(spark, sf))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return series.points_of(_job_ops(spark, sf))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    """What passes the text filter, at every poll."""
    return filters.filter_components(_job_ops(spark, sf), derived.LAYOUT, "exe1")


def _latest_top(spark: SparkSession, sf: str) -> DataFrame:
    return topn.latest(topn.top_jobs_filtered(_states(spark, sf)))


def _ops(df: DataFrame) -> DataFrame:
    return df.select("poll", "job_id", "operation", "value")


# Sources: text to counters.


@query
def parse_job_stats(spark, sf):
    parsed = dumps.parse_job_stats(derived.dumps(spark, sf))
    return parsed.drop("poll_time", "hist")


@query
def parse_histogram(spark, sf):
    parsed = dumps.parse_job_stats(derived.dumps(spark, sf))
    return dumps.parse_histogram(parsed).select("poll_ts", "host", "job_id", "operation", "bucket", "count")


@query
def parse_messy_dumps(spark, sf):
    buckets = "array_join(transform(array_sort(map_entries(hist)), e -> concat(e.key, '=', e.value)), ',') AS buckets"
    parsed = dumps.parse_job_stats(derived.messy_dumps(spark, sf))
    return parsed.selectExpr("poll_ts", "host", "param", "job_id", "operation", "samples", "unit", buckets)


@query
def parse_flat_blocks(spark, sf):
    return dumps.parse_flat_blocks(derived.flat_dumps(_points(spark, sf)))


@query
def raw_log_frames(spark, sf):
    blocks = derived.dumps(spark, sf)
    framed = blocks.select(raw_log.frame_text(blocks).alias("value"))
    parsed = dumps.parse_job_stats(raw_log.split_frames(framed))
    return parsed.select("poll_ts", "host", "param", "job_id", "operation", "samples")


@query
def parse_large_dumps(spark, sf):
    """Dumps written as logs and read again, cut at their jobs instead of their blocks."""
    folder = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    write_raw_log(derived.dumps(spark, sf), folder)
    parsed = dumps.parse_job_stats(large_dumps.read_large_logs(spark, folder))
    return parsed.select("poll_ts", "host", "param", "job_id", "operation", "samples")


@query
def scoped_log_store(spark, sf):
    """Metadata targets of two servers over some polls, from a store by day, kind of target and server."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    write_log_store(derived.dumps(spark, sf), folder)
    blocks = raw_log.read_log_store(spark, folder, ["oss0", "oss2"], mdt=True, start=START + 50, end=START + 210)
    return dumps.parse_job_stats(blocks).select("poll_ts", "host", "param", "job_id", "operation", "samples")


@query
def rates_from_raw_log(spark, sf):
    blocks = derived.dumps(spark, sf)
    framed = blocks.select(raw_log.frame_text(blocks).alias("value"))
    table = merge.job_table(dumps.parse_job_stats(raw_log.split_frames(framed)).drop("poll_time"))
    numbered = merge.with_poll_numbers(table, derived.polls(spark, sf))
    return _ops(rates.rates(numbered))


@query
def poll_register(spark, sf):
    """Numbers only the polls that have rows, the empty one is not among them."""
    return merge.poll_register(derived.samples(spark, sf))


def _quoted(points: DataFrame) -> DataFrame:
    return points.withColumn("job_id", F.concat(F.lit('"'), "job_id", F.lit('"')))


@query
def prometheus_roundtrip(spark, sf):
    return formats.parse_prometheus(_quoted(_points(spark, sf)).select(formats.prometheus_line().alias("value")))


@query
def victoriametrics_roundtrip(spark, sf):
    return formats.parse_json_lines(victoriametrics_lines(_quoted(_points(spark, sf))))


@query
def victoriametrics_series_roundtrip(spark, sf):
    return formats.parse_json_lines(victoriametrics_lines(_quoted(_points(spark, sf)), per_series=True))


# Merging.


@query
def scope_ost(spark, sf):
    scoped = merge.scope_sources(derived.samples(spark, sf), ost=True)
    return scoped.select("poll", "host", "param", "job_id", "operation", "samples")


@query
def scope_servers(spark, sf):
    scoped = merge.scope_sources(derived.samples(spark, sf), servers=["oss0", "oss2"], param="mdt.fs-MDT000?.*")
    return scoped.select("poll", "host", "param", "job_id", "operation", "samples")


@query
def merge_jobs(spark, sf):
    return _ops(merge.merge_jobs(derived.samples(spark, sf), with_total=False))


@query
def merge_with_ops(spark, sf):
    return _ops(_job_ops(spark, sf))


@query
def merge_with_bytes(spark, sf):
    return _ops(merge.merge_jobs(derived.samples_with_bytes(spark, sf), include_bytes=True))


@query
def job_table(spark, sf):
    return _table(spark, sf).select(
        "poll", "job_id", "snapshot_time", "ops", "open", "read", "write", "close", "getattr", "setattr"
    )


@query
def job_times(spark, sf):
    return merge.job_times(derived.samples(spark, sf)).drop("poll_ts")


@query
def group_by_user(spark, sf):
    return _ops(merge.merge_jobs(derived.samples(spark, sf), derived.LAYOUT, "user"))


@query
def group_by_host(spark, sf):
    return _ops(merge.merge_jobs(derived.samples(spark, sf), derived.LAYOUT, "host_short"))


@query
def rates_by_user(spark, sf):
    return _ops(rates.rates(merge.job_table(derived.samples(spark, sf), derived.LAYOUT, "user")))


@query
def job_components(spark, sf):
    jobs = derived.samples(spark, sf).select("job_id").distinct()
    return jobs.select("job_id", *derived.LAYOUT.columns(F.col("job_id")))


@query
def poll_summary(spark, sf):
    return merge.poll_summary(derived.samples(spark, sf), derived.polls(spark, sf)).drop("poll_ts")


# Rates, shares and peaks.


@query
def rate_between_polls(spark, sf):
    return _ops(merge.to_long(_rates(spark, sf)))


@query
def diff_between_polls(spark, sf):
    return _ops(merge.to_long(_rates(spark, sf, "diff")))


@query
def sampling_windows(spark, sf):
    return rates.sampling_windows(_rates(spark, sf))


@query
def totals(spark, sf):
    return shares.totals(_table(spark, sf)).select("poll", "operation", "value")


@query
def percent_of_total(spark, sf):
    return _ops(shares.percent(_job_ops(spark, sf)))


@query
def percent_table(spark, sf):
    return _ops(merge.to_long(shares.percent_table(_table(spark, sf))))


@query
def peak_ops(spark, sf):
    return peaks.peak_ops(shares.totals(_rates(spark, sf)))


@query
def peak_jobs(spark, sf):
    entry = "array_join(transform(array_sort(map_entries(ops)), e -> concat(e.key, '=', e.value)), ',') AS ops"
    return peaks.peak_jobs(_rates(spark, sf)).selectExpr("operation", "job_id", "rate", entry, "timestamp")


@query
def running_peak_ops(spark, sf):
    return peaks.running_peak_ops(shares.totals(_rates(spark, sf)))


@query
def running_peak_jobs(spark, sf):
    """In chunks of four polls, so that most peaks are carried over edges."""
    return peaks.running_peak_jobs(_rates(spark, sf), polls_per_chunk=4)


# Filters.


def _patterns(spark, sf):
    """Ends, beginnings and middles of some ids, one of three characters and some that match nothing."""
    users = derived.events(spark, sf).select("user_id").distinct()
    each = """array(if(user_id % 9 = 2, concat('.n', user_id), NULL), if(user_id % 13 = 5, concat(user_id % 25, '.n', user_id % 7), NULL),
              if(user_id % 50 = 7, concat('n', user_id, '.'), NULL), if(user_id = 8, 'n99', NULL))"""
    return users.select(F.explode(F.expr(each)).alias("pattern"))


@query
def filter_many_patterns(spark, sf):
    """Drops jobs by a table of patterns."""
    return _ops(patterns.filter_jobs_by(_job_ops(spark, sf), _patterns(spark, sf)))


@query
def keep_many_patterns(spark, sf):
    return _ops(patterns.filter_jobs_by(_job_ops(spark, sf), _patterns(spark, sf), invert=True))


@query
def filter_exclude(spark, sf):
    return _ops(filters.filter_jobs(_job_ops(spark, sf), PATTERNS))


@query
def filter_include(spark, sf):
    return _ops(filters.filter_jobs(_job_ops(spark, sf), PATTERNS, invert=True))


@query
def filter_exact(spark, sf):
    return _ops(filters.exclude_exact(_job_ops(spark, sf), IDS))


@query
def select_inclusive(spark, sf):
    return _ops(filters.select_jobs(_job_ops(spark, sf), IDS, "inclusive"))


@query
def select_exclusive(spark, sf):
    return _ops(filters.select_jobs(_job_ops(spark, sf), IDS, "exclusive"))


@query
def min_rate(spark, sf):
    return _ops(merge.to_long(filters.min_rate(_rates(spark, sf), 20)))


@query
def long_min_rate(spark, sf):
    return _ops(filters.long_min_rate(_job_ops(spark, sf), 500))


@query
def active_jobs(spark, sf):
    return _ops(filters.has_activity(merge.to_long(_rates(spark, sf))))


@query
def filter_ops(spark, sf):
    return _ops(filters.filter_ops(_job_ops(spark, sf)))


@query
def known_ops(spark, sf):
    return _ops(filters.filter_ops(_job_ops(spark, sf), None))


@query
def op_short_names(spark, sf):
    ops = _job_ops(spark, sf)
    short = vocabulary.short_name(F.col("operation"))
    return ops.select("poll", "job_id", short.alias("short_name"), vocabulary.long_name(short).alias("long_name"), "value")


@query
def filter_component(spark, sf):
    wanted = {"user": "1", "host_short": "n"}
    return _ops(filters.filter_components(_job_ops(spark, sf), derived.LAYOUT, components=wanted))


@query
def time_window(spark, sf):
    return filters.time_window(_points(spark, sf), START + 50, START + 100)


@query
def prune_before(spark, sf):
    return filters.prune_before(_points(spark, sf), filters.live_cutoff(START + 290, 60))


# Top lists.


def _listed(top: DataFrame, *columns: str) -> DataFrame:
    return top.select("poll", F.col("rank").cast("bigint").alias("rank"), "job_id", *columns)


@query
def top_jobs(spark, sf):
    return _listed(topn.top_jobs(_rates(spark, sf)), "ops", "sampling_window")


@query
def top_jobs_by_op(spark, sf):
    return _listed(topn.top_jobs(_rates(spark, sf), "write"), "ops", "write")


@query
def top_jobs_page(spark, sf):
    return _listed(topn.top_jobs(_rates(spark, sf), skip=5), "ops")


@query
def top_jobs_percent(spark, sf):
    return _listed(topn.top_jobs(shares.percent_table(_table(spark, sf)), min_rate=0), "ops")


@query
def top_jobs_matching(spark, sf):
    return _listed(topn.top_jobs(_table(spark, sf), patterns=PATTERNS, invert=True, count=3), "ops")


@query
def top_jobs_exact(spark, sf):
    return _listed(topn.top_jobs_exact(_table(spark, sf), IDS), "ops")


@query
def top_jobs_filtered(spark, sf):
    return _listed(topn.top_jobs_filtered(_states(spark, sf)), "total")


@query
def scrolled_jobs(spark, sf):
    return _listed(topn.page(topn.top_jobs_filtered(_states(spark, sf)), 2, 5), "total")


@query
def job_table_pivot(spark, sf):
    return topn.job_columns(_job_ops(spark, sf), PIVOT_OPS).drop("poll_ts")


@query
def top_job_bars(spark, sf):
    states = _states(spark, sf)
    return bars.top_job_bars(states, topn.top_jobs_filtered(states)).drop("poll_ts")


@query
def top_job_rates(spark, sf):
    return bars.top_job_rates(_points(spark, sf), _latest_top(spark, sf), END)


@query
def top_job_series(spark, sf):
    return bars.top_job_series(_points(spark, sf), _latest_top(spark, sf), START + 100)


@query
def top_job_rate_series(spark, sf):
    return bars.top_job_rate_series(_points(spark, sf), _latest_top(spark, sf), START + 100)


@query
def op_totals_filtered(spark, sf):
    return bars.visible_op_totals(_states(spark, sf)).drop("poll_ts")


# Series and replay.


@query
def time_range(spark, sf):
    return series.time_range(_points(spark, sf))


@query
def distinct_ops(spark, sf):
    return series.catalog_ops(_points(spark, sf))


@query
def distinct_jobs(spark, sf):
    return series.catalog_jobs(_points(spark, sf))


@query
def op_series(spark, sf):
    return series.op_series(_points(spark, sf), "read", START + 50).select("timestamp", "value")


@query
def op_series_rate(spark, sf):
    return series.op_series_rate(_points(spark, sf))


@query
def job_series(spark, sf):
    return series.job_series(_points(spark, sf), JOB, ["open", "read"], START + 50)


@query
def get_series(spark, sf):
    return series.get_series(_points(spark, sf), JOB, "open", START + 50)


@query
def jobs_with_ops(spark, sf):
    return series.jobs_with_ops(_points(spark, sf), ["open", "read"], START + 50)


@query
def series_rate(spark, sf):
    return series.series_rate(_points(spark, sf))


@query
def series_rate_chunked(spark, sf):
    """In chunks shorter than the gaps of many series, so that edges are carried over whole chunks."""
    return series.series_rate(_points(spark, sf), chunk_seconds=15)


@query
def rates_chunked(spark, sf):
    """Few polls to a chunk: most pairs of polls have one on either side of an edge."""
    return _ops(merge.to_long(rates.job_rates(_table(spark, sf), polls_per_chunk=3)))


@query
def latest_rate(spark, sf):
    return series.latest_rate(_points(spark, sf), START + 290)


@query
def latest_op_rate(spark, sf):
    return series.latest_op_rate(_points(spark, sf), vocabulary.DEFAULT_OPERATIONS, START + 290)


@query
def cap_series(spark, sf):
    return series.cap_series(_points(spark, sf), 10)


@query
def points_by_time(spark, sf):
    """Every point with its place in the order of time."""
    ordered = series.by_time(_points(spark, sf)).select("timestamp", "job_id", "operation", "value")
    at = F.monotonically_increasing_id().alias("at")
    placed = ordered.select("*", at)
    before = Window.partitionBy("timestamp").orderBy("at")
    return placed.select("timestamp", "job_id", "operation", "value", F.row_number().over(before).alias("place"))


@query
def state_at(spark, sf):
    return replay.state_at(_points(spark, sf), START + 155).select("job_id", "operation", "value")


@query
def state_at_snapshots(spark, sf):
    """``state_at`` from stored states of a minute each, the last minutes taken in again."""
    points = _points(spark, sf).persist()
    try:
        store = snapshots.SnapshotStore(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", 60)
        store.replace(points.where(F.col("timestamp") < START + 180))
        store.replace(points.where(F.col("timestamp") >= START + 120))
    finally:
        points.unpersist()
    return store.state_at(START + 155).select("job_id", "operation", "value")


@query
def replay_intervals(spark, sf):
    return replay.replay_intervals(_points(spark, sf))


@query
def replay_frames(spark, sf):
    return replay.replay_frames(_points(spark, sf), 25, START, END)


@query
def replay_frames_chunked(spark, sf):
    return replay.replay_frames(_points(spark, sf), 25, START, END, chunk_seconds=15)


@query
def downsample(spark, sf):
    return replay.downsample(_points(spark, sf), START, START + 290, 7)


# Display values.


def _poll_totals(spark: SparkSession, sf: str) -> DataFrame:
    return shares.totals(_table(spark, sf))


@query
def human_counts(spark, sf):
    return _poll_totals(spark, sf).select("poll", "operation", display.human_count(F.col("value")).alias("shown"))


@query
def log_heights(spark, sf):
    return _poll_totals(spark, sf).select("poll", "operation", display.log_height(F.col("value")).alias("height"))


@query
def axis_ceilings(spark, sf):
    ceiling = F.round(display.nice_ceiling(F.col("value"))).cast("bigint")
    return _poll_totals(spark, sf).select("poll", "operation", ceiling.alias("ceiling"))


@query
def chart_axis(spark, sf):
    return series.axis(series.op_series(_points(spark, sf)), START + 100).select("operation", "x", "value")


@query
def chart_maximum(spark, sf):
    return series.axis_max(series.op_series(_points(spark, sf)))


@query
def clocks(spark, sf):
    at = F.col("timestamp")
    start, end = display.trailing_window(at, F.lit(START + 40), 100)
    share = display.progress(at, F.lit(START), F.lit(START + 290))
    return _points(spark, sf).select("timestamp").distinct().select(
        "timestamp",
        display.utc_time(at).alias("utc_time"),
        display.utc_clock(at).alias("utc_clock"),
        F.round(share * 1000000).cast("bigint").alias("progress"),
        start.alias("window_start"),
        end.alias("window_end"),
    )


@query
def short_ids(spark, sf):
    job = F.col("job_id")
    return derived.samples(spark, sf).select("job_id").distinct().select(
        "job_id", display.truncate_id(job, 8).alias("cut"), display.pad_label(F.concat(job, F.lit(":"))).alias("padded")
    )


def _report(spark: SparkSession, sf: str, options: report.Options) -> DataFrame:
    result = report.build(derived.samples(spark, sf), derived.polls(spark, sf), options)
    return report.lines(result, options).select("poll", "line")


@query
def report_lines(spark, sf):
    return _report(spark, sf, report.Options(mode="rate", total=True))


@query
def report_peaks(spark, sf):
    """With the peaks as they stood after each poll."""
    return _report(spark, sf, report.Options(peaks=True))


@query
def report_diff(spark, sf):
    return _report(spark, sf, report.Options(mode="diff", total=True, count=3))
