"""All-time peaks: the best poll of each operation and the best job.

Peaks are a minimum under a fixed order (highest value, then earliest time, then
job id), so folding old and new peaks together is associative and repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtally.functions.vocabulary import LONG_NAMES
from jobtally.operators.merge import operation_columns
from jobtally.operators.rates import POLLS_PER_CHUNK
from jobtally.operators.skew import first_by

PEAK_OPS = "operation STRING, rate BIGINT, timestamp BIGINT"
PEAK_JOBS = "operation STRING, job_id STRING, rate BIGINT, ops MAP<STRING,BIGINT>, timestamp BIGINT"


def peak_ops(totals: DataFrame) -> DataFrame:
    """Per operation the highest total and the first time it was reached."""
    return fold_peak_ops(
        totals.select("operation", F.col("value").alias("rate"), F.col("poll_ts").alias("timestamp"))
    )


def fold_peak_ops(peaks: DataFrame) -> DataFrame:
    best = peaks.groupBy("operation").agg(first_by("0", "-rate AS loss", "timestamp").alias("_b"))
    return best.selectExpr("operation", "-_b.loss AS rate", "_b.timestamp AS timestamp")


def peak_jobs(table: DataFrame) -> DataFrame:
    """Per operation the job with the highest value ever, and all its values then.

    One pass over the wide rows with a single buffer row per task: no shuffle of
    data and no sort, only one candidate per operation leaves a task.
    """
    names = operation_columns(table)
    vector = f"struct({', '.join(names)})"
    best = table.agg(
        *[
            F.expr(
                f"min(CASE WHEN {name} > 0 THEN struct(-{name} AS loss, poll_ts, job_id, {vector} AS vector) END) AS {name}"
            )
            for name in names
        ]
    )
    rows = ", ".join(f"struct('{name}' AS operation, {name} AS best)" for name in names)
    pairs = ", ".join(f"'{name}', r.best.vector.{name}" for name in names)
    return (
        best.selectExpr(f"explode(array({rows})) AS r")
        .where("r.best IS NOT NULL")
        .selectExpr(
            "r.operation AS operation",
            "r.best.job_id AS job_id",
            "-r.best.loss AS rate",
            f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS ops",
            "r.best.poll_ts AS timestamp",
        )
    )


def fold_peak_jobs(peaks: DataFrame) -> DataFrame:
    """The best of several peak tables; jobs at 0 are never peaks.

    A map cannot be compared, so it takes part as its sorted entries.
    """
    best = (
        peaks.where("rate > 0")
        .groupBy("operation")
        .agg(first_by("sort_array(map_entries(ops)) AS entries", "-rate AS loss", "timestamp", "job_id").alias("_b"))
    )
    return best.selectExpr(
        "operation",
        "_b.job_id AS job_id",
        "-_b.loss AS rate",
        "map_from_entries(_b.entries) AS ops",
        "_b.timestamp AS timestamp",
    )


def _running(best: DataFrame, polls_per_chunk: int) -> DataFrame:
    """The least ``best`` of each operation up to each poll.

    Polls are taken in chunks: a window group holds one chunk, and one row per
    operation and chunk carries what came before.
    """
    chunked = best.withColumn("_chunk", F.expr(f"coalesce(poll div {polls_per_chunk}, 0L)"))
    chunks = chunked.groupBy("operation", "_chunk").agg(F.min("best").alias("best"))
    before = Window.partitionBy("operation").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("operation", "_chunk", F.min("best").over(before).alias("_carried"))
    here = Window.partitionBy("operation", "_chunk").orderBy("poll").rowsBetween(Window.unboundedPreceding, 0)
    within = chunked.withColumn("best", F.min("best").over(here))
    return within.join(carried, ["operation", "_chunk"]).select("poll", "operation", F.least("best", "_carried").alias("best"))


def _at_polls(best: DataFrame, polls: DataFrame | None, names: list[str]) -> DataFrame:
    """Rows for every one of ``polls`` and operation, with a null where there is no value; as they are without polls."""
    if polls is None:
        return best
    every = polls.select("poll", F.explode(F.array(*[F.lit(name) for name in names])).alias("operation"))
    return every.join(best, ["poll", "operation"], "left")


def running_peak_ops(totals: DataFrame, polls_per_chunk: int = POLLS_PER_CHUNK, polls: DataFrame | None = None) -> DataFrame:
    """``peak_ops`` as it stood after each poll in which the operation has a total, or after each of ``polls``."""
    best = totals.selectExpr("poll", "operation", "struct(-value AS loss, poll_ts AS timestamp) AS best")
    found = _running(_at_polls(best, polls, LONG_NAMES), polls_per_chunk).where("best IS NOT NULL")
    return found.selectExpr("poll", "operation", "-best.loss AS rate", "best.timestamp AS timestamp")


def running_peak_jobs(
    table: DataFrame, polls_per_chunk: int = POLLS_PER_CHUNK, polls: DataFrame | None = None, vectors: bool = False
) -> DataFrame:
    """The best job of each operation as it stood after each poll in which a job used the operation, or each of ``polls``.

    With ``vectors`` all values that job had then are given, too, as the map ``ops``.
    """
    names = operation_columns(table)
    held = f", struct({', '.join(names)}) AS vector" if vectors else ""
    leaders = table.groupBy("poll").agg(
        *[F.expr(f"min(CASE WHEN {name} > 0 THEN struct(-{name} AS loss, poll_ts AS timestamp, job_id{held}) END) AS {name}") for name in names]
    )
    best = leaders.unpivot("poll", names, "operation", "best").where("best IS NOT NULL")
    pairs = ", ".join(f"'{name}', best.vector.{name}" for name in names)
    ops = [f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL) AS ops"] if vectors else []
    return _running(_at_polls(best, polls, names), polls_per_chunk).where("best IS NOT NULL").selectExpr(
        "poll", "operation", "best.job_id AS job_id", "-best.loss AS rate", *ops, "best.timestamp AS timestamp"
    )
