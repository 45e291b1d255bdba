"""Merging parsed counters over servers: per poll, job and operation.

Two shapes are offered. ``merge_jobs`` is long, keeps every operation name and
feeds exports and replay. ``job_table`` is wide, one row per poll and job with a
column per vocabulary operation; it needs one shuffle, of rows a fraction of the
long size, and carries everything rates, shares, top lists and peaks need.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtally.functions.globs import glob_pattern, scope_param
from jobtally.functions.layout import JobIdLayout
from jobtally.functions.vocabulary import BYTE_OPERATIONS, LONG_NAMES, TOTAL
from jobtally.operators.skew import salted_join

POLL_COLUMNS = ("poll", "poll_ts", "poll_time")
TIMES = ("snapshot_time", "start_time", "elapsed_time")


def poll_keys(df: DataFrame) -> list[str]:
    """The columns of ``df`` that identify a poll."""
    return [name for name in POLL_COLUMNS if name in df.columns]


def scope_sources(
    samples: DataFrame,
    servers: Iterable[str] | None = None,
    param: str = "*.*.job_stats",
    ost: bool = False,
    mdt: bool = False,
) -> DataFrame:
    """Keep the given servers and the targets whose parameter fits a glob."""
    kept = samples.where(F.col("param").rlike(glob_pattern(scope_param(param, ost, mdt))))
    return kept if servers is None else kept.where(F.col("host").isin(*servers))


def rekey(df: DataFrame, layout: JobIdLayout | None, groupby: str) -> DataFrame:
    """Replace job ids by one component of theirs (``none`` keeps them)."""
    if groupby == "none":
        return df
    if layout is None:
        raise ValueError(f"grouping by {groupby!r} needs a job-id layout")
    return df.withColumn("job_id", layout.group_key(F.col("job_id"), groupby))


def _is_merged(include_bytes: bool) -> Column:
    """Metrics that count: used at least once, byte counters only on demand.

    A metric that bears the name of the total would be counted twice.
    """
    name = F.col("operation")
    kept = (F.col("samples") != 0) & (name != TOTAL)
    return kept if include_bytes else kept & ~name.isin(*BYTE_OPERATIONS)


def merge_jobs(
    samples: DataFrame,
    layout: JobIdLayout | None = None,
    groupby: str = "none",
    include_bytes: bool = False,
    with_total: bool = True,
) -> DataFrame:
    """Sum samples per poll, job and operation, in long form.

    The total over all operations of a job comes out of the same shuffle: each
    row counts for its operation and for the total, and both are summed within
    the task before anything is sent.
    """
    kept = rekey(samples.where(_is_merged(include_bytes)), layout, groupby)
    if with_total:
        kept = kept.withColumn("operation", F.explode(F.array("operation", F.lit(TOTAL))))
    job = [*poll_keys(samples), "job_id"]
    return kept.groupBy(*job, "operation").agg(F.sum("samples").cast("bigint").alias("value"))


def job_times(samples: DataFrame, layout: JobIdLayout | None = None, groupby: str = "none") -> DataFrame:
    """Latest snapshot, start and elapsed time per poll and (re-keyed) job.

    A job has a row here even if none of its metrics was used: this is the
    record that the job existed in that poll.
    """
    job = [*poll_keys(samples), "job_id"]
    return rekey(samples, layout, groupby).groupBy(*job).agg(*_latest(samples))


def _latest(samples: DataFrame) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        (F.greatest(F.max(name), zero) if name in samples.columns else zero).alias(name) for name in TIMES
    ]


def operation_columns(table: DataFrame) -> list[str]:
    """The vocabulary columns of a wide table, in vocabulary order."""
    return [name for name in LONG_NAMES if name in table.columns]


def job_table(
    samples: DataFrame,
    layout: JobIdLayout | None = None,
    groupby: str = "none",
    include_bytes: bool = False,
) -> DataFrame:
    """One row per poll and job: times, ``ops`` and a column per operation.

    ``ops`` counts every merged metric, also names outside the vocabulary, which
    have no column. A column is null where the job never showed that metric.
    """
    names = [n for n in LONG_NAMES if n != TOTAL and (include_bytes or n not in BYTE_OPERATIONS)]
    job = [*poll_keys(samples), "job_id"]
    return (
        rekey(samples, layout, groupby)
        .groupBy(*job)
        .agg(
            *_latest(samples),
            F.sum(F.when(_is_merged(include_bytes), F.col("samples"))).alias(TOTAL),
            *[F.expr(f"sum(CASE WHEN operation = '{name}' AND samples <> 0 THEN samples END) AS {name}") for name in names],
        )
    )


def to_long(table: DataFrame) -> DataFrame:
    """A wide table as (poll, job_id, operation, value) rows, without a shuffle."""
    names = operation_columns(table)
    keys = [*poll_keys(table), "job_id"]
    return table.unpivot(keys, names, "operation", "value").where(F.col("value").isNotNull())


def poll_register(blocks: DataFrame) -> DataFrame:
    """Every poll that was logged, numbered 0, 1, ... in time order.

    Numbering runs per day, so no task sorts more than one day of polls; the
    days before are added as an offset. Polls without any job count too.
    """
    # A day that cannot be null keeps the planner from filtering one branch of the join only, so that the logs are
    # read once and both branches share the shuffle of distinct polls.
    day = F.expr("coalesce(poll_ts div 86400L, 0L) AS _day")
    seen = blocks.select("poll_ts", day).distinct()
    per_day = seen.groupBy("_day").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_day = F.row_number().over(Window.partitionBy("_day").orderBy("poll_ts"))
    return (
        seen.withColumn("_at", in_day - 1)
        .join(offsets, "_day")
        .select((F.col("_offset") + F.col("_at")).cast("bigint").alias("poll"), "poll_ts")
    )


def with_poll_numbers(df: DataFrame, register: DataFrame) -> DataFrame:
    """Attach poll numbers to merged rows. A poll may hold most of the rows, so
    its rows are spread over several join keys."""
    return salted_join(df, register, ["poll_ts"], "job_id")


def poll_summary(samples: DataFrame, polls: DataFrame) -> DataFrame:
    """Jobs, servers and targets observed per poll, and seconds since the poll
    before; 0 seconds where that poll was empty and rates start over.

    Jobs and targets are made distinct in one pass over the samples, as rows of
    two kinds that are combined within each task; each poll then meets the one
    before as a second row under the next number.
    """
    no_param = F.lit(None).cast("string").alias("param")
    both = F.array(F.struct(F.col("job_id").alias("name"), no_param), F.struct(F.col("host").alias("name"), "param"))
    seen = samples.select("poll", F.inline(both)).distinct()
    kind = F.split_part("param", F.lit("."), F.lit(1))
    counted = seen.groupBy("poll").agg(
        F.count(F.when(F.col("param").isNull(), 1)).alias("total_jobs"),
        F.size(F.collect_set(F.when(F.col("param").isNotNull(), F.col("name")))).cast("bigint").alias("servers"),
        F.count(F.when(kind == "obdfilter", 1)).alias("osts"),
        F.count(F.when(kind == "mdt", 1)).alias("mdts"),
    )
    counts = ["total_jobs", "servers", "osts", "mdts"]
    rows = polls.join(counted, "poll", "left").na.fill(0, counts)
    twice = rows.withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1))))
    met = twice.groupBy((F.col("poll") + F.col("_later")).alias("poll")).agg(
        F.max(F.when(F.col("_later") == 0, F.struct("poll_ts", *counts))).alias("_own"),
        F.max(F.when((F.col("_later") == 1) & (F.col("total_jobs") > 0), F.col("poll_ts"))).alias("_before"),
    )
    waited = F.expr("coalesce(_own.poll_ts - _before, 0L) AS query_duration")
    return met.where("_own IS NOT NULL").select("poll", "_own.*", waited)
