"""Readers of stored peaks: the append-only tables, and the JSON database."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtally.operators.peaks import PEAK_JOBS, PEAK_OPS, fold_peak_jobs, fold_peak_ops

JSON_PEAKS = (
    "top_ops MAP<STRING,STRUCT<rate:BIGINT,timestamp:BIGINT>>, "
    "top_job_per_op MAP<STRING,STRUCT<job_id:STRING,ops:MAP<STRING,BIGINT>,timestamp:BIGINT>>"
)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_peaks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Peaks of operations and of jobs so far, empty before the first write.

    Writers only append, so reading folds all that was ever written; a batch
    written twice after a failure changes nothing.
    """
    return (
        fold_peak_ops(_read_or_empty(spark, f"{path}/ops", PEAK_OPS)),
        fold_peak_jobs(_read_or_empty(spark, f"{path}/jobs", PEAK_JOBS)),
    )


def read_peaks_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A peak database in JSON: 28 operations at most, read as one document."""
    db = spark.read.text(path, wholetext=True).select(F.from_json("value", JSON_PEAKS).alias("d"))
    ops = db.select(F.explode("d.top_ops").alias("operation", "p")).select("operation", "p.rate", "p.timestamp")
    jobs = (
        db.select(F.explode("d.top_job_per_op").alias("operation", "p"))
        .where("p.job_id <> ''")
        .selectExpr(
            "operation", "p.job_id", "coalesce(try_element_at(p.ops, operation), 0L) AS rate", "p.ops", "p.timestamp"
        )
    )
    return ops, jobs
