"""Totals over all jobs of a poll and each job's share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtally.functions.vocabulary import is_known
from jobtally.operators.merge import operation_columns, poll_keys
from jobtally.operators.skew import salted_join


def total_table(table: DataFrame) -> DataFrame:
    """One row per poll: the sum of every operation column over all jobs."""
    return table.groupBy(*poll_keys(table)).agg(*[F.sum(name).alias(name) for name in operation_columns(table)])


def totals(table: DataFrame) -> DataFrame:
    """``total_table`` as (poll, operation, value) rows."""
    sums = total_table(table)
    return sums.unpivot(poll_keys(sums), operation_columns(sums), "operation", "value").where("value IS NOT NULL")


def long_totals(job_ops: DataFrame) -> DataFrame:
    """Totals of long rows; names outside the vocabulary have none."""
    kept = job_ops.where(is_known(F.col("operation")))
    return kept.groupBy(*poll_keys(job_ops), "operation").agg(F.sum("value").cast("bigint").alias("value"))


def percent_table(table: DataFrame) -> DataFrame:
    """Wide rows with every counter as a whole percentage of its poll total."""
    names, keys = operation_columns(table), poll_keys(table)
    sums = total_table(table).select(*keys, F.struct(*names).alias("_total"))
    share = "CASE WHEN {0} IS NULL THEN NULL WHEN _total.{0} = 0 THEN 0L ELSE {0} * 100 div greatest(_total.{0}, 1L) END AS {0}"
    others = [name for name in table.columns if name not in names]
    return salted_join(table, sums, keys, "job_id").selectExpr(*others, *[share.format(name) for name in names])


def percent(job_ops: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Long rows as whole percentages of the total of their operation.

    Names outside the vocabulary have no total and pass through unscaled.
    """
    keys = [*poll_keys(job_ops), "operation"]
    if totals is None:  # of every name, so that the rows and their sums share one shuffle
        sums, how = job_ops.groupBy(*keys).agg(F.sum("value").cast("bigint").alias("_total")), "inner"
    else:
        sums, how = totals.select(*keys, F.col("value").alias("_total")), "left"
    share = F.expr("CASE WHEN coalesce(_total, 0L) = 0 THEN 0L ELSE value * 100 div greatest(_total, 1L) END")
    return salted_join(job_ops, sums, keys, "job_id", how).select(
        *poll_keys(job_ops), "job_id", "operation",
        F.when(is_known(F.col("operation")), share).otherwise(F.col("value")).alias("value"),
    )
