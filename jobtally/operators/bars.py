"""Numbers behind the bar and line charts of the top jobs, of every poll or of one state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from jobtally.functions.vocabulary import DEFAULT_OPERATIONS
from jobtally.operators.filters import filter_ops, since
from jobtally.operators.merge import poll_keys
from jobtally.operators.series import latest_rate, operation_sums, per_operation, series_rate


def visible_op_totals(visible: DataFrame, enabled: Iterable[str] = DEFAULT_OPERATIONS) -> DataFrame:
    """Sum of each enabled operation over the visible jobs of a poll, 0 where absent."""
    enabled, keys = list(enabled), poll_keys(visible)
    sums = visible.groupBy(*keys) if keys else visible.groupBy()
    return per_operation(sums.agg(*operation_sums(enabled)), keys, enabled)


def _cells(values: DataFrame, top: DataFrame, enabled: list[str], keys: list[str]) -> DataFrame:
    """Every enabled operation of every top job, also of jobs without a row in ``values``."""
    wide = filter_ops(values, enabled).groupBy(*keys).agg(*operation_sums(enabled))
    return per_operation(top.select(*keys).join(wide, keys, "left"), keys, enabled)


def top_job_bars(job_ops: DataFrame, top: DataFrame, enabled: Iterable[str] = DEFAULT_OPERATIONS) -> DataFrame:
    """The value of every enabled operation of every top job, 0 where absent."""
    keys = [*(k for k in poll_keys(job_ops) if k in top.columns), "job_id"]
    return _cells(job_ops, top, list(enabled), keys)


def top_job_rates(
    points: DataFrame, top: DataFrame, now: int, window: int = 60, enabled: Iterable[str] = DEFAULT_OPERATIONS
) -> DataFrame:
    """The last rate, within a trailing window, of every enabled operation of every top job, 0 where unseen."""
    enabled = list(enabled)
    mine = filter_ops(points, enabled).join(top.select("job_id"), "job_id", "left_semi")
    return _cells(latest_rate(mine, now, window), top, enabled, ["job_id"])


def _of_top(points: DataFrame, top: DataFrame, start: int, enabled: Iterable[str]) -> DataFrame:
    return filter_ops(since(points, start), list(enabled)).join(top.select("job_id"), "job_id", "left_semi")


def top_job_series(
    points: DataFrame, top: DataFrame, start: int, enabled: Iterable[str] = DEFAULT_OPERATIONS
) -> DataFrame:
    """The points of the enabled operations of the top jobs from a time on."""
    return _of_top(points, top, start, enabled)


def top_job_rate_series(
    points: DataFrame, top: DataFrame, start: int, enabled: Iterable[str] = DEFAULT_OPERATIONS
) -> DataFrame:
    """The rates between those points."""
    return series_rate(_of_top(points, top, start, enabled))
