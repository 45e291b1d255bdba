"""Top lists of jobs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtally.functions.arithmetic import any_of
from jobtally.functions.layout import JobIdLayout
from jobtally.functions.vocabulary import DEFAULT_OPERATIONS, TOTAL, check_operation
from jobtally.operators import filters
from jobtally.operators.merge import operation_columns, poll_keys


def _ranked(table: DataFrame, sortby: str, count: int, skip: int) -> DataFrame:
    """Rank by one column, ties by job id, and keep ``count`` after ``skip``.

    Per poll where there are polls: only the leading rows of a poll leave a task.
    """
    order = [F.coalesce(F.col(sortby), F.lit(0).cast("bigint")).desc(), F.col("job_id").asc()]
    polls = [name for name in ("poll", "poll_ts") if name in table.columns][:1]
    if polls:
        rank = F.row_number().over(Window.partitionBy(*polls).orderBy(*order))
        return table.withColumn("rank", rank).where((F.col("rank") <= skip + count) & (F.col("rank") > skip))
    page = table.orderBy(*order).offset(skip).limit(count) if skip else table.orderBy(*order).limit(count)
    return page.withColumn("rank", skip + F.row_number().over(Window.orderBy(*order)))


def top_jobs(
    table: DataFrame,
    sortby: str = TOTAL,
    count: int = 5,
    min_rate: int = 1,
    patterns: Iterable[str] = (),
    invert: bool = False,
    skip: int = 0,
) -> DataFrame:
    """The leading jobs of every poll of a wide counter, rate or percent table."""
    check_operation(sortby)
    active = filters.min_rate(filters.filter_jobs(table, patterns, invert), min_rate)
    if min_rate < 0:
        active = active.where(any_of([F.coalesce(F.col(n), F.lit(0)) != 0 for n in operation_columns(table)]))
    return _ranked(active, sortby, count, skip)


def top_jobs_exact(
    table: DataFrame, excluded: Iterable[str], sortby: str = TOTAL, count: int = 5, min_rate: int = 0
) -> DataFrame:
    """The leading jobs without those excluded by exact id."""
    check_operation(sortby)
    return _ranked(filters.min_rate(filters.exclude_exact(table, excluded), min_rate), sortby, count, 0)


def visible_jobs(
    job_ops: DataFrame,
    layout: JobIdLayout | None = None,
    full: str = "",
    components: Mapping[str, str] | None = None,
    selected: Iterable[str] | DataFrame = (),
    mode: str = "none",
) -> DataFrame:
    """Long rows of the jobs that pass the text filters and the selection."""
    layout = layout or JobIdLayout(())
    return filters.select_jobs(filters.filter_components(job_ops, layout, full, components), selected, mode)


def job_totals(job_ops: DataFrame, enabled: Iterable[str] = DEFAULT_OPERATIONS) -> DataFrame:
    """Sum of the enabled operations per job."""
    keys = [*poll_keys(job_ops), "job_id"]
    return filters.filter_ops(job_ops, enabled).groupBy(*keys).agg(F.sum("value").cast("bigint").alias("total"))


def top_jobs_filtered(
    visible: DataFrame, enabled: Iterable[str] = DEFAULT_OPERATIONS, count: int = 10
) -> DataFrame:
    """The jobs with the largest positive sum of enabled operations, of every poll or of one state."""
    if count < 1:
        raise ValueError("count must be at least 1")
    return _ranked(job_totals(visible, enabled).where("total > 0"), "total", count, 0)


def page(top: DataFrame, skip: int, count: int) -> DataFrame:
    """Scroll a top list: leave out ``skip`` rows of each poll, show ``count``."""
    return top.where((F.col("rank") > skip) & (F.col("rank") <= skip + count))


def latest(polls: DataFrame) -> DataFrame:
    """The rows of the newest poll."""
    newest = polls.agg(F.max("poll").alias("poll"))
    return polls.join(newest, "poll")


def job_columns(
    visible: DataFrame, enabled: Iterable[str] = DEFAULT_OPERATIONS, shown: Iterable[str] | None = None
) -> DataFrame:
    """Jobs of every poll with their total and each enabled operation, or each of ``shown``, as a column."""
    enabled = list(enabled)
    columns = enabled if shown is None else list(shown)
    return (
        filters.filter_ops(visible, enabled)
        .groupBy(*poll_keys(visible), "job_id")
        .agg(
            F.sum("value").cast("bigint").alias("total"),
            *[
                F.sum(F.when(F.col("operation") == name, F.col("value")).otherwise(0)).cast("bigint").alias(name)
                for name in columns
            ],
        )
        .where("total > 0")
    )
