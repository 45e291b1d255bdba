"""Replay of recorded points: the state at a time, at every frame, thinned out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtally.operators.filters import time_window
from jobtally.operators.series import SERIES
from jobtally.operators.skew import CHUNK_SECONDS, beside


def state_at(points: DataFrame, at: int) -> DataFrame:
    """The last value of each series at or before a time."""
    past = points.where(F.col("timestamp") <= at)
    return past.groupBy(*SERIES).agg(
        F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("timestamp")
    )


FRAMES_AT_ONCE = 1000  # the longest sequence that one row is expanded to


def replay_intervals(points: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """When each value was the current one: (series, from, to, value); ``to`` is the next point's time or null."""
    return beside(points, SERIES, forward=True, chunk_seconds=chunk_seconds).selectExpr(
        *SERIES, "timestamp AS `from`", "beside.timestamp AS `to`", "value"
    )


def replay_frames(
    points: DataFrame, step: int, start: int, end: int, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """The state at ``start``, ``start + step``, ... up to ``end``.

    A point is valid until the next one of its series, so it is shown in the
    frames of that interval; no frame is ever joined to the points. Every series
    is in every frame after its first point, so the result grows with both: ask
    for what is shown and keep ``replay_intervals`` of a long history.
    """
    last = (end - start) // step
    if step < 1 or last < 0:
        raise ValueError("step must be positive and end not before start")
    numbered = (
        replay_intervals(points.where(F.col("timestamp") <= end), chunk_seconds)
        .selectExpr(
            *SERIES,
            "value",
            f"CASE WHEN `from` <= {start} THEN 0L ELSE (`from` - {start} + {step - 1}) div {step} END AS _from",
            f"least({last}L, coalesce((`to` - {start} + {step - 1}) div {step} - 1, {last}L)) AS _to",
        )
        .where("_to >= _from")
    )
    parts = numbered.selectExpr(*SERIES, "value", "_to", f"explode(sequence(_from, _to, {FRAMES_AT_ONCE}L)) AS _part")
    return parts.selectExpr(
        *SERIES, "value", f"explode(sequence(_part, least(_to, _part + {FRAMES_AT_ONCE - 1}))) AS _frame"
    ).selectExpr(f"{start} + _frame * {step} AS frame", *SERIES, "value")


def downsample(points: DataFrame, start: int, end: int, target: int) -> DataFrame:
    """At most about ``target`` moments between two times.

    Points are put into buckets from ``start`` on and the last point of each
    series in a bucket is kept. The width follows from the period and ``target``
    alone, so what one job shows does not depend on how many rows others have.
    """
    if target < 1:
        raise ValueError("target must be at least 1")
    width = max(1, max(1, end - start) // target)
    bucket = F.call_function("div", F.col("timestamp") - start, F.lit(width).cast("bigint"))
    return (
        time_window(points, start, end)
        .withColumn("_bucket", bucket)
        .groupBy("_bucket", *SERIES)
        .agg(F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("timestamp"))
        .select("timestamp", *SERIES, "value")
    )
