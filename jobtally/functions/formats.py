"""Text formats of exported points, as column expressions in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names and headers of the text exports.
PROMETHEUS_METRIC = "lustre_job_op_total"
PROMETHEUS_HEADER = (
    "# HELP lustre_job_op_total Total operations per job and operation type\n"
    "# TYPE lustre_job_op_total counter\n"
)
JSON_METRIC = "lustre_job_op"
JSON_LINE = "metric MAP<STRING,STRING>, values ARRAY<BIGINT>, timestamps ARRAY<BIGINT>, _bad STRING"

MILLIS = 1000


def millis(seconds: Column) -> Column:
    return seconds * MILLIS


def seconds(millis: Column) -> Column:
    return F.call_function("div", millis, F.lit(MILLIS).cast("bigint"))


def escape_label(text: Column) -> Column:
    """Backslash, quote and line end as a label value shows them."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def unescape_label(text: Column) -> Column:
    """The inverse of ``escape_label``: what stands between escaped backslashes is undone piece by piece."""
    undo = lambda piece: F.replace(F.replace(piece, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), undo), "\\")


def prometheus_line() -> Column:
    """A point as one exposition line with a time in milliseconds."""
    return F.concat(
        F.lit(PROMETHEUS_METRIC + '{job_id="'), escape_label(F.col("job_id")),
        F.lit('",operation="'), escape_label(F.col("operation")), F.lit('"} '),
        F.col("value").cast("string"), F.lit(" "), millis(F.col("timestamp")).cast("string"),
    )


def parse_prometheus(lines: DataFrame) -> DataFrame:
    """Points of exposition lines; comments and other metrics are skipped."""
    label = r'((?:[^"\\]|\\.)+)'
    pattern = rf'{PROMETHEUS_METRIC}\{{job_id="{label}",operation="{label}"\}}\s+(\d+)\s+(\d+)'
    part = lambda group: F.regexp_extract("value", pattern, group)
    whole = lambda group: F.coalesce(part(group).try_cast("bigint"), F.lit(0).cast("bigint"))
    return (
        lines.where(~F.col("value").startswith("#") & F.col("value").contains(PROMETHEUS_METRIC + "{"))
        .select(
            seconds(whole(4)).alias("timestamp"),
            unescape_label(part(1)).alias("job_id"),
            unescape_label(part(2)).alias("operation"),
            whole(3).alias("_value"),
        )
        .where("job_id <> ''")
        .withColumnRenamed("_value", "value")
    )


def json_line(values: Column, timestamps: Column) -> Column:
    """A series, or a single point of it, as one JSON line."""
    labels = F.create_map(
        F.lit("__name__"), F.lit(JSON_METRIC), F.lit("job_id"), F.col("job_id"), F.lit("operation"), F.col("operation")
    )
    return F.to_json(F.struct(labels.alias("metric"), values.alias("values"), timestamps.alias("timestamps")))


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """Points of JSON lines; lines that lack a field or have a wrong type are
    skipped, missing labels are empty and missing times 0."""
    row = F.from_json("value", JSON_LINE, {"columnNameOfCorruptRecord": "_bad"})
    nothing = lambda name: F.exists(F.col(f"_r.{name}"), lambda item: item.isNull())
    label = lambda name: F.coalesce(F.try_element_at("_r.metric", F.lit(name)), F.lit("")).alias(name)
    good = lines.select(row.alias("_r")).where(
        "_r._bad IS NULL AND _r.metric IS NOT NULL AND _r.values IS NOT NULL AND _r.timestamps IS NOT NULL"
    )
    return (
        good.where(~nothing("values") & ~nothing("timestamps"))
        .select(
            label("job_id"), label("operation"), F.col("_r.timestamps").alias("_times"),
            F.posexplode("_r.values").alias("_at", "value"),
        )
        .select(
            seconds(F.coalesce(F.get("_times", F.col("_at")), F.lit(0).cast("bigint"))).alias("timestamp"),
            "job_id", "operation", "value",
        )
    )
