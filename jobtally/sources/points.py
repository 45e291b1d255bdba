"""Readers of exported points: (timestamp, job_id, operation, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtally.functions.formats import parse_json_lines, parse_prometheus
from jobtally.operators.merge import merge_jobs
from jobtally.operators.series import points_of
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.raw_log import read_raw_log

# Endings of file names and the format they stand for.
FORMAT_ENDINGS = {
    ".parquet": "parquet",
    ".raw.log": "raw",
    ".raw": "raw",
    "-raw.txt": "raw",
    ".prom": "prometheus",
    ".prometheus": "prometheus",
    ".vm.json": "victoriametrics",
    ".victoriametrics": "victoriametrics",
    "-victoriametrics.json": "victoriametrics",
}

_TIMES = ("timestamp", "timestamp_ntz")


def _at(seconds: int, kind: str) -> Column:
    """Epoch seconds as a time of the stored kind; a zoneless time is UTC."""
    if kind == "timestamp":
        return F.timestamp_seconds(F.lit(seconds))
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span


def read_points_parquet(
    spark: SparkSession, path: str | list[str], start: int | None = None, end: int | None = None
) -> DataFrame:
    """Exported Parquet; rows with a null are skipped, wrong columns an error.

    The stored time may be with or without a zone; both count from the epoch.
    ``start`` and ``end`` (both included) skip whole days and row groups, which a
    filter on the seconds this returns could not.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    types = dict(df.dtypes)
    wanted = {"timestamp": _TIMES, "job_id": ("string",), "operation": ("string",), "value": ("bigint",)}
    for name, allowed in wanted.items():
        if types.get(name) not in allowed:
            raise ValueError(f"column {name!r} must be {' or '.join(allowed)}, found {types.get(name)}")
    kind = types["timestamp"]
    day = lambda seconds: F.date_from_unix_date(F.lit(seconds // 86400))
    by_day = types.get("date") == "date"
    if start is not None:
        df = df.where(F.col("timestamp") >= _at(start, kind))
        df = df.where(F.col("date") >= day(start)) if by_day else df
    if end is not None:
        df = df.where(F.col("timestamp") < _at(end + 1, kind))
        df = df.where(F.col("date") <= day(end)) if by_day else df
    if kind == "timestamp":
        when = F.unix_seconds("timestamp")
    else:
        when = F.timestamp_diff("SECOND", _at(0, kind), F.col("timestamp"))
    return df.select(*wanted).dropna().select(when.alias("timestamp"), "job_id", "operation", "value")


def read_prometheus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_prometheus(spark.read.text(path))


def read_victoriametrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_json_lines(spark.read.text(path))


def read_raw_points(spark: SparkSession, path: str | list[str], include_bytes: bool = False) -> DataFrame:
    """Points of framed dumps: parsed and merged per poll."""
    samples = parse_job_stats(read_raw_log(spark, path)).drop("poll_time")
    return points_of(merge_jobs(samples, include_bytes=include_bytes))


READERS = {
    "parquet": read_points_parquet,
    "prometheus": read_prometheus,
    "victoriametrics": read_victoriametrics,
    "raw": read_raw_points,
}


def detect_format(path: str) -> str:
    """Format by the ending of a file, folder or glob."""
    name = path.rstrip("/*")
    for ending, fmt in FORMAT_ENDINGS.items():
        if name.endswith(ending):
            return fmt
    raise ValueError(f"cannot tell the format of {path!r}; name it, or use one of {', '.join(FORMAT_ENDINGS)}")


def load_points(
    spark: SparkSession, path: str, fmt: str | None = None, start: int | None = None, end: int | None = None
) -> DataFrame:
    """Points of a file, folder or glob of any format, within optional bounds.

    Exports of the pseudo metric ``job_id``, a marker some writers add, are
    dropped: the existence of a job is no counter.
    """
    fmt = fmt or detect_format(path)
    if fmt == "parquet":
        points = read_points_parquet(spark, path, start, end)
    else:
        points = READERS[fmt](spark, path)
        points = points if start is None else points.where(F.col("timestamp") >= start)
        points = points if end is None else points.where(F.col("timestamp") <= end)
    return points.where(F.col("operation") != "job_id")
