"""Row filters on jobs, operations, id components and time."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtally.functions.arithmetic import any_of
from jobtally.functions.layout import JobIdLayout
from jobtally.functions.vocabulary import DEFAULT_OPERATIONS, TOTAL, is_known
from jobtally.operators.merge import poll_keys


def filter_jobs(df: DataFrame, patterns: Iterable[str], invert: bool = False) -> DataFrame:
    """Drop jobs whose id contains any pattern, or with ``invert`` keep only those.

    Without patterns everything is kept, or with ``invert`` nothing.
    """
    patterns = list(patterns)
    if "" in patterns:
        raise ValueError("an empty pattern would match every job")
    matches = any_of([F.col("job_id").contains(text) for text in patterns])
    return df.where(matches if invert else ~matches)


def _in(df: DataFrame, ids: DataFrame | Iterable[str], how: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return df.join(ids.select("job_id"), "job_id", how)
    listed = F.col("job_id").isin(*ids)
    return df.where(listed if how == "left_semi" else ~listed)


def exclude_exact(df: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """Drop jobs by exact id, from a list or from a DataFrame of ``job_id``."""
    return _in(df, ids, "left_anti")


def select_jobs(df: DataFrame, ids: DataFrame | Iterable[str], mode: str = "none") -> DataFrame:
    """Apply a selection: ``none`` keeps all, ``inclusive`` only, ``exclusive`` not."""
    if mode == "none":
        return df
    if mode not in ("inclusive", "exclusive"):
        raise ValueError(f"mode must be none, inclusive or exclusive, not {mode!r}")
    return _in(df, ids, "left_semi" if mode == "inclusive" else "left_anti")


def min_rate(table: DataFrame, above: int = 1) -> DataFrame:
    """Keep the rows of a wide table whose ``ops`` lies above a bound."""
    return table.where(F.coalesce(F.col(TOTAL), F.lit(0)) > above)


def _job_window(job_ops: DataFrame) -> Window:
    """The long rows of one job in one poll: one per operation."""
    return Window.partitionBy(*poll_keys(job_ops), "job_id")


def long_min_rate(job_ops: DataFrame, above: int = 1) -> DataFrame:
    """``min_rate`` for long rows; a job without an ``ops`` row counts as 0."""
    total = F.max(F.when(F.col("operation") == TOTAL, F.col("value"))).over(_job_window(job_ops))
    return job_ops.withColumn("_ops", F.coalesce(total, F.lit(0))).where(F.col("_ops") > above).drop("_ops")


def has_activity(job_ops: DataFrame) -> DataFrame:
    """Keep the long rows of jobs that have any value other than 0."""
    active = F.max((F.col("value") != 0)).over(_job_window(job_ops))
    return job_ops.withColumn("_active", active).where("_active").drop("_active")


def filter_ops(df: DataFrame, enabled: Iterable[str] | None = DEFAULT_OPERATIONS) -> DataFrame:
    """Keep some operations: the nine defaults, a list, or all 28 with ``None``."""
    operation = F.col("operation")
    return df.where(is_known(operation) if enabled is None else operation.isin(*enabled))


def filter_components(
    df: DataFrame, layout: JobIdLayout, full: str = "", components: Mapping[str, str] | None = None
) -> DataFrame:
    """Keep jobs whose id contains ``full`` and whose components contain theirs.

    A job too short to have a filtered component is dropped.
    """
    job_id = F.col("job_id")
    kept = df.where(job_id.contains(full)) if full else df
    for name, text in (components or {}).items():
        if text:
            kept = kept.where(F.get(layout.parts(job_id), F.lit(layout.position(name))).contains(text))
    return kept


def time_window(points: DataFrame, start: int | Column, end: int | Column) -> DataFrame:
    """Points between two times, both included."""
    return points.where(F.col("timestamp").between(start, end))


def since(points: DataFrame, start: int) -> DataFrame:
    return points.where(F.col("timestamp") >= start)


def prune_before(points: DataFrame, cutoff: int) -> DataFrame:
    """Drop points older than a cutoff; series left empty are gone with them."""
    return since(points, cutoff)


def live_cutoff(now: int, window: int) -> int:
    """Age limit of a live view that shows ``window`` seconds."""
    return now - 2 * window
