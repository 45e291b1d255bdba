"""Rates and differences between adjacent polls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtally.functions.arithmetic import change_per
from jobtally.functions.vocabulary import TOTAL
from jobtally.operators.merge import operation_columns, to_long

POLLS_PER_CHUNK = 1024


def job_rates(table: DataFrame, mode: str = "rate", polls_per_chunk: int = POLLS_PER_CHUNK) -> DataFrame:
    """Change of every counter of every job since the poll just before.

    ``table`` is a ``job_table`` with poll numbers. A job yields a row where it
    is present in polls n-1 and n and its own snapshot time has moved on; that
    move, not the poll interval, divides the rate. Metrics first seen in poll n
    stay null, metrics gone from it give 0, resets give 0.

    Polls of a job are compared in chunks of adjacent poll numbers: the last
    poll of a chunk is repeated at the head of the next. So a window group never
    exceeds ``polls_per_chunk + 1`` rows however long the history, and a job seen
    in all polls still spreads over the cluster.
    """
    if mode not in ("rate", "diff"):
        raise ValueError(f"mode must be 'rate' or 'diff', not {mode!r}")
    names = operation_columns(table)
    facts = ["poll", "poll_ts", "snapshot_time", *names]
    seconds = "sampling_window" if mode == "rate" else None
    # One lag per column: all share a window, and columns a query leaves out are
    # not carried through the shuffle.
    before = [f"lag({name}) OVER (PARTITION BY job_id, _chunk ORDER BY poll) AS _b_{name}" for name in facts]
    return (
        table.withColumn("_chunk", F.explode(_chunks("poll", polls_per_chunk)))
        .selectExpr("job_id", *facts, *before)
        .withColumn("sampling_window", F.expr("snapshot_time - _b_snapshot_time"))
        .where("_b_poll = poll - 1 AND sampling_window > 0")
        .selectExpr(
            "poll",
            "poll_ts",
            "job_id",
            "sampling_window",
            "poll_ts - _b_poll_ts AS query_duration",
            *[f"{change_per(f'_b_{name}', name, seconds)} AS {name}" for name in names],
        )
    )


def _chunks(poll: str, size: int) -> Column:
    """The chunk of a poll, and for the last poll of a chunk the next one too."""
    return F.expr(
        f"""CASE WHEN {poll} % {size} = {size - 1} THEN array({poll} div {size}, {poll} div {size} + 1)
            ELSE array({poll} div {size}) END"""
    )


def rates(table: DataFrame, mode: str = "rate") -> DataFrame:
    """``job_rates`` in long form: (poll, poll_ts, job_id, operation, value)."""
    return to_long(job_rates(table, mode))


def sampling_windows(rate_table: DataFrame) -> DataFrame:
    """Seconds between the two snapshots compared, per poll and job."""
    return rate_table.select("poll", "job_id", "sampling_window", "query_duration")


def has_rates(rate_table: DataFrame) -> DataFrame:
    """Jobs with at least one rate; a job that used nothing before has none."""
    return rate_table.where(F.col(TOTAL).isNotNull())
