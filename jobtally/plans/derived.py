"""Job counters derived from the ``events`` table, for queries and the benchmark.

Each day of events is one poll, ten seconds apart in counter time. Counters are
cumulative, with resets, vanishing jobs and metrics, one empty poll, one
operation outside the vocabulary and three hosts built in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtally.functions.layout import JobIdLayout

POLL_ZERO = 1704067200
LAYOUT = JobIdLayout.parse("%e.%u.%H")
_JOB = ["user_id", "host_no"]  # numbers that tell the jobs of a host apart
_DAYS = range(31)  # days of a month, the widest a series can get


def _long(value: int):
    return F.lit(value).cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(
        "dayofmonth(ts) - 1 AS poll",
        "user_id",
        """CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write'
           WHEN 'error' THEN 'close' ELSE if(user_id % 7 = 0, 'mystery_op', 'getattr') END AS operation""",
        "event_id % 3 AS host_no",
        "10 + event_id % 90 AS weight",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per poll, host, job and operation: the cumulative counter.

    One shuffle: the days of a series are summed side by side before it, and the
    running sum needs only a sort of what is already partitioned by series.
    """
    return _samples(spark, sf_dir).drop(*_JOB)


def _samples(spark: SparkSession, sf_dir: str, by_job: bool = False) -> DataFrame:
    """``samples`` with the numbers of user and host; ``by_job``: dealt by them while a series is still one row."""
    rows = _classified(spark, sf_dir)
    series = ["user_id", "operation", "host_no"]
    by_series = rows.groupBy(*series).agg(
        F.min("poll").alias("first_poll"),
        *[F.expr(f"sum(CASE WHEN poll = {day} THEN weight END) AS d{day}") for day in _DAYS],
    )
    if by_job:
        by_series = by_series.repartition(*_JOB)
    polls_seen = F.broadcast(rows.select("poll").distinct())  # days of a month, 31 rows at most
    days = ", ".join(f"d{day}" for day in _DAYS)
    dense = (
        by_series.selectExpr(*series, "first_poll", f"posexplode(array({days})) AS (poll, grown)")
        .where("poll >= first_poll")
        .join(polls_seen, "poll", "left_semi")
        .withColumn("era", F.expr("user_id % 10 = 0 AND poll >= 15"))
    )
    running = Window.partitionBy(*series, "era").orderBy("poll").rowsBetween(Window.unboundedPreceding, 0)
    return (
        dense.withColumn("samples", F.sum(F.expr("coalesce(grown, 0L)")).over(running))
        .where(
            "poll <> 20 AND (user_id + poll) % 11 <> 0 AND NOT (operation = 'getattr' AND poll % 5 = 4)"
        )
        .selectExpr(*series, "samples", "poll", f"{POLL_ZERO}L + poll * 10 AS poll_ts", f"{POLL_ZERO}L - user_id % 50 AS start")
        .selectExpr(
            "CAST(poll AS BIGINT) AS poll",
            "poll_ts",
            "concat('oss', host_no) AS host",
            """concat(if(operation IN ('read', 'write'), 'obdfilter.fs-OST000', 'mdt.fs-MDT000'),
                      host_no, '.job_stats') AS param""",
            "concat('exe', user_id % 4, '.', user_id % 25, '.n', user_id) AS job_id",
            "poll_ts + host_no AS snapshot_time",
            "start AS start_time",
            "poll_ts + host_no - start AS elapsed_time",
            "operation",
            "samples",
            *_JOB,
        )
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll register: every poll, also the one in which no job was seen."""
    days = events(spark, sf_dir).selectExpr("CAST(dayofmonth(ts) - 1 AS BIGINT) AS poll").distinct()
    return days.selectExpr("poll", f"{POLL_ZERO}L + poll * 10 AS poll_ts")


_METRIC = (
    "struct<param:string,operation:string,samples:bigint,unit:string,"
    "min:bigint,max:bigint,sum:bigint,hist:map<string,bigint>>"
)


def samples_with_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples`` plus byte counters with histograms and idle metrics.

    Every read and write row is followed by its byte counter, and each
    (poll, host, job) has one ``statfs`` metric of 0 samples.
    """
    return _samples_with_bytes(spark, sf_dir).drop(*_JOB)


def _samples_with_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples_with_bytes`` with the numbers of user and host, dealt by them."""
    first = Window.partitionBy("poll", *_JOB).orderBy("operation")
    count, zero = F.col("samples"), _long(0)
    no_hist = F.create_map().cast("map<string,bigint>")
    mdt = F.concat(F.lit("mdt.fs-MDT000"), F.right("host", F.lit(1)), F.lit(".job_stats"))
    calls = F.struct("param", "operation", count, F.lit("reqs"), zero, zero, zero, no_hist)
    size = F.struct(
        "param", F.concat("operation", F.lit("_bytes")), count, F.lit("bytes"),
        _long(4096), _long(1048576), count * 65536, F.create_map(F.lit("64K"), count),
    )
    idle = F.struct(mdt, F.lit("statfs"), zero, F.lit("reqs"), zero, zero, zero, no_hist)
    extra = F.array(
        calls.cast(_METRIC),
        F.when(F.col("operation").isin("read", "write"), size.cast(_METRIC)),
        F.when(F.row_number().over(first) == 1, idle.cast(_METRIC)),
    )
    return (
        _samples(spark, sf_dir, by_job=True)
        .withColumn("_metrics", extra)
        .withColumn("metric", F.explode("_metrics"))
        .where("metric IS NOT NULL")
        .select("poll", "poll_ts", "host", "job_id", "snapshot_time", "start_time", "elapsed_time", "metric.*", *_JOB)
    )


JOBS_PER_BLOCK = 20


def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples_with_bytes`` rendered as dump blocks, the input of the parser.

    A block holds a page of at most ``JOBS_PER_BLOCK`` jobs of one target, so it
    stays short however many jobs there are.
    """
    line = """concat('  ', rpad(concat(operation, ':'), 17, ' '), '{ samples: ', lpad(samples, 11, ' '), ', unit: ', unit,
              if(unit = 'bytes', concat(', min: ', min, ', max: ', max, ', sum: ', sum, ', hist: { 64K: ', hist['64K'], ' }'), ''),
              ' }\n')"""
    head = """concat('- job_id:          ', job_id, '\n  snapshot_time:   ', snapshot_time, '.123456789\n',
              '  start_time:      ', start_time, '.5\n  elapsed_time:    ', elapsed_time, '.0\n')"""
    target = ["poll_ts", "host", "param"]
    job = ["job_id", "snapshot_time", "start_time", "elapsed_time"]
    # By user and host no row moves, until the pages are put together.
    jobs = (
        _samples_with_bytes(spark, sf_dir)
        .selectExpr(*target, *job, *_JOB, f"{line} AS line")
        .groupBy(*target, *job, *_JOB)
        .agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("lines"))
    )
    page = f"CAST(split_part(job_id, '.n', 2) AS BIGINT) div {JOBS_PER_BLOCK} AS page"
    return (
        jobs.selectExpr(*target, page, f"concat({head}, lines) AS text")
        .groupBy(*target, "page")
        .agg(F.concat(F.lit("job_stats:\n"), F.array_join(F.sort_array(F.collect_list("text")), "")).alias("data"))
        .selectExpr("host", "param", "timestamp_seconds(poll_ts) AS poll_time", "poll_ts", "data")
    )


def messy_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples`` as odd but legal text, another kind for each executable.

    Text before the first job, blank lines, tabs, a metric that is given twice,
    histograms of two buckets and without braces, numbers that are none.
    """
    line = """CASE left(job_id, 4)
        WHEN 'exe0' THEN concat('\\t', operation, ': { samples: 1, unit: reqs }\\n\\n  ', operation, ':    { samples: ', samples, ', unit: reqs }\\n')
        WHEN 'exe1' THEN concat('\\n  ', operation, ': { samples: ', samples, ', unit: bytes, min: 1, max: 9, sum: 10, hist: { 4K: 1, 8K: ', samples, ' } }\\n')
        WHEN 'exe2' THEN concat('  ', operation, ': { samples: x', samples, ', unit: reqs }\\n')
        ELSE concat('  ', operation, ':{samples:', samples, ',unit:usecs,hist:7}\\n   \\n') END"""
    job = ["poll_ts", "host", "param", "job_id"]
    jobs = _samples(spark, sf_dir, by_job=True).selectExpr(*job, *_JOB, f"{line} AS line").groupBy(*job, *_JOB).agg(
        F.array_join(F.sort_array(F.collect_list("line")), "").alias("lines")
    )
    text = r"concat('a note { samples: 5 }\njob_stats:\n\n- job_id:\t', job_id, '\n', lines) AS data"
    return jobs.selectExpr("host", "param", "poll_ts", text)


def flat_dumps(points: DataFrame) -> DataFrame:
    """Points rendered in the flat dialect, a block per time and job.

    Odd values are written plainly, even ones as a metric with samples.
    """
    line = """concat('  ', operation, ': ', if(value % 2 = 1, CAST(value AS STRING),
              concat('{ samples: ', value, ', unit: reqs }')), '\n')"""
    return (
        points.selectExpr("timestamp", "job_id", f"{line} AS line")
        .groupBy("timestamp", "job_id")
        .agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("lines"))
        .selectExpr(
            "timestamp AS poll_ts", "concat('job_id: ', job_id, '\n  snapshot_time: ', timestamp, '\n', lines) AS data"
        )
    )
