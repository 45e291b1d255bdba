"""Time series over points: (timestamp, job_id, operation, value).

Points hold at most one value per (timestamp, job_id, operation), as every
exporter writes them; ``unique_points`` restores that after overlapping logs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtally.operators.filters import since
from jobtally.operators.skew import CHUNK_SECONDS, beside

SERIES = ["job_id", "operation"]


def points_of(job_ops: DataFrame) -> DataFrame:
    """Merged long rows as points, timed by their poll."""
    return job_ops.select(F.col("poll_ts").alias("timestamp"), "job_id", "operation", "value")


def unique_points(points: DataFrame) -> DataFrame:
    """One value, the largest, per timestamp, job and operation."""
    return points.groupBy("timestamp", *SERIES).agg(F.max("value").alias("value"))


def time_range(points: DataFrame) -> DataFrame:
    return points.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def by_time(points: DataFrame) -> DataFrame:
    """Points in the order of time, for output; jobs and operations of one time in theirs.

    A range sort: only the last step of a query should ask for it.
    """
    return points.orderBy("timestamp", *SERIES)


def catalog_jobs(points: DataFrame) -> DataFrame:
    return points.select("job_id").distinct().orderBy("job_id")


def catalog_ops(points: DataFrame) -> DataFrame:
    return points.select("operation").distinct().orderBy("operation")


def get_series(points: DataFrame, job_id: str, operation: str, start: int) -> DataFrame:
    """One job, one operation, from a time on."""
    mine = (F.col("job_id") == job_id) & (F.col("operation") == operation)
    return since(points, start).where(mine).select("timestamp", "value")


def op_series(points: DataFrame, operation: str | None = None, start: int | None = None) -> DataFrame:
    """Sum over all jobs per timestamp, of one operation or of each."""
    kept = points if start is None else since(points, start)
    if operation is not None:
        kept = kept.where(F.col("operation") == operation)
    return kept.groupBy("operation", "timestamp").agg(F.sum("value").cast("bigint").alias("value"))


def job_series(points: DataFrame, job_id: str, operations: Iterable[str], start: int) -> DataFrame:
    """Sum of some operations of one job per timestamp, repeats counted once."""
    mine = since(points, start).where((F.col("job_id") == job_id) & F.col("operation").isin(*operations))
    once = mine.groupBy("operation", "timestamp").agg(F.max("value").alias("value"))
    return once.groupBy("timestamp").agg(F.sum("value").cast("bigint").alias("value"))


def jobs_with_ops(points: DataFrame, operations: Iterable[str], start: int) -> DataFrame:
    """Jobs with any point of some operations from a time on."""
    return since(points, start).where(F.col("operation").isin(*operations)).select("job_id").distinct()


def has_job(points: DataFrame, job_id: str) -> DataFrame:
    """One row if the job is known, none otherwise."""
    return points.where(F.col("job_id") == job_id).select("job_id").limit(1)


def _rate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rate between each point and the one before; resets are 0, repeats dropped."""
    return pairs.where("timestamp > beside.timestamp").selectExpr(
        *keys,
        "timestamp",
        "greatest(value - beside.value, 0L) div greatest(timestamp - beside.timestamp, 1L) AS value",
    )


def series_rate(
    points: DataFrame, keys: list[str] | None = None, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Per-second change between consecutive points of each series."""
    keys = SERIES if keys is None else keys
    return _rate(beside(points, keys, chunk_seconds=chunk_seconds), keys)


def op_series_rate(points: DataFrame, start: int | None = None) -> DataFrame:
    """Rate of each operation summed over all jobs."""
    return series_rate(op_series(points, None, start), ["operation"])


def latest_rate(points: DataFrame, now: int, window: int = 60, keys: list[str] | None = None) -> DataFrame:
    """The last rate within a trailing window per series, 0 with fewer than two points.

    The window bounds a group: a series has few points in it.
    """
    keys = SERIES if keys is None else keys
    recent = points.where(F.col("timestamp").between(now - window, now))
    before = Window.partitionBy(*keys).orderBy("timestamp")
    rate = F.expr(
        """CASE WHEN timestamp > beside.timestamp
           THEN greatest(value - beside.value, 0L) div greatest(timestamp - beside.timestamp, 1L) END"""
    )
    paired = recent.withColumn("beside", F.lag(F.struct("timestamp", "value")).over(before)).withColumn("rate", rate)
    last = F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("timestamp")))
    return paired.groupBy(*keys).agg(F.coalesce(last, F.lit(0).cast("bigint")).alias("value"))


def latest_op_rate(points: DataFrame, operations: Iterable[str], now: int, window: int = 60) -> DataFrame:
    """The last rate of each listed operation over all jobs, 0 where unseen."""
    operations = list(operations)
    recent = points.where(F.col("timestamp").between(now - window, now) & F.col("operation").isin(*operations))
    found = latest_rate(op_series(recent), now, window, ["operation"])
    return per_operation(found.agg(*operation_sums(operations)), [], operations)


def operation_sums(names: list[str]) -> list[Column]:
    """Sums of ``value`` by operation, in numbered columns: metric names are free text and may be no column names."""
    return [F.sum(F.when(F.col("operation") == name, F.col("value"))).cast("bigint").alias(f"_op{n}") for n, name in enumerate(names)]


def per_operation(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Columns of ``operation_sums`` as rows (keys..., operation, value), 0 where there is none."""
    if not names:
        return wide.select(*keys, F.lit("").alias("operation"), F.lit(0).cast("bigint").alias("value")).where("false")
    numbered = wide.unpivot(keys, [f"_op{n}" for n in range(len(names))], "_at", "value")
    name = F.get(F.array(*[F.lit(name) for name in names]), F.substr("_at", F.lit(4)).cast("int"))
    return numbered.select(*keys, name.alias("operation"), F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def cap_series(points: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` points of each series.

    Every task passes on at most ``count`` points of a series, so a long series
    does not travel to one place.
    """
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("timestamp"), F.desc("value"))
    return points.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= count).drop("_n")


def axis(series: DataFrame, start: int) -> DataFrame:
    """Series as chart coordinates: seconds after ``start`` and the value."""
    return series.where(F.col("timestamp") >= start).withColumn("x", F.col("timestamp") - start)


def axis_max(series: DataFrame) -> DataFrame:
    """Largest value shown, 100 at least."""
    return series.agg(F.greatest(F.lit(100).cast("bigint"), F.max("value")).alias("max_value"))
