"""Framed dump logs: one block per server, parameter and poll.

A block is a header line naming host, parameter and time, the dump, and an end
line. Files are cut at the headers by the text source, so they stay splittable.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtally.functions.globs import glob_pattern, scope_param

# The framing of a block.
HEADER_START = "### HOST:"
HEADER_PATTERN = r"^ ?(.*?) \| PARAM: (.*?) \| TIMESTAMP: "
TIME_PATTERN = r"TIMESTAMP: (\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)) ###"
END_LINE = "### END ###"

LINE_SEP = "\n" + HEADER_START


def split_frames(texts: DataFrame) -> DataFrame:
    """Text cut at the headers as blocks (host, param, poll_time, poll_ts, data).

    Blocks without a valid time or without an end line are skipped.
    """
    value = F.col("value")
    text = F.when(value.startswith(HEADER_START), F.substr(value, F.lit(len(HEADER_START) + 1))).otherwise(value)
    header = F.substring_index("_text", "\n", 1)
    body = F.substr(F.col("_text"), F.length("_header") + 1)
    end = "\n" + END_LINE
    return (
        texts.select(text.alias("_text"))
        .withColumn("_header", header)
        .withColumn("poll_time", F.try_to_timestamp(F.nullif(F.regexp_extract("_header", TIME_PATTERN, 1), F.lit(""))))
        .where(F.col("poll_time").isNotNull() & F.col("_text").contains(end))
        .select(
            F.regexp_extract("_header", HEADER_PATTERN, 1).alias("host"),
            F.regexp_extract("_header", HEADER_PATTERN, 2).alias("param"),
            "poll_time",
            F.unix_seconds("poll_time").alias("poll_ts"),
            F.substr(F.substring_index(body, end, 1), F.lit(2)).alias("data"),
        )
    )


def frame_text(blocks: DataFrame) -> Column:
    """A block as framed text; the time with microseconds and a UTC offset."""
    clock = F.coalesce("poll_time", F.timestamp_seconds("poll_ts")) if "poll_time" in blocks.columns else (
        F.timestamp_seconds("poll_ts")
    )
    since = F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(clock) / F.lit(1000000).cast("decimal(18,0)")).cast("decimal(18,6)")
    )
    utc = F.date_format(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(
        F.lit(HEADER_START + " "), "host", F.lit(" | PARAM: "), "param",
        F.lit(" | TIMESTAMP: "), utc, F.lit("+00:00 ###\n"), "data", F.lit("\n" + END_LINE + "\n"),
    )


def read_raw_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks of one or many framed logs."""
    return split_frames(spark.read.option("lineSep", LINE_SEP).text(path))


def stream_raw_log(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Blocks of framed logs as they appear in a folder."""
    reader = spark.readStream.option("lineSep", LINE_SEP)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return split_frames(reader.text(folder))


def log_day(seconds: str) -> Column:
    """The UTC day of a poll, as a log store names it."""
    return F.date_from_unix_date(F.expr(f"CAST({seconds} div 86400 AS INT)"))


def target_kind(param: str) -> Column:
    """What a parameter is about: its part before the first dot."""
    return F.substring_index(param, ".", 1)


def read_log_store(
    spark: SparkSession,
    path: str,
    servers: Iterable[str] | None = None,
    param: str = "*.*.job_stats",
    ost: bool = False,
    mdt: bool = False,
    start: int | None = None,
    end: int | None = None,
) -> DataFrame:
    """Blocks of a store of ``write_log_store``: those of some servers, targets and times (both ends included).

    Servers, the kind of target and days pick folders before any text is read. Of a glob, the text up to the first dot
    counts, if it has no wildcard; what is left to check is checked on the headers.
    """
    schema = "value string, day date, kind string, server string"
    rows = spark.read.option("lineSep", LINE_SEP).schema(schema).text(path)
    scope = scope_param(param, ost, mdt)
    kind, dot, _ = scope.partition(".")
    if dot and not set(kind) & set("*?["):
        rows = rows.where(F.col("kind") == kind)
    if servers is not None:
        servers = list(servers)
        rows = rows.where(F.col("server").isin(*servers))
    day = lambda seconds: F.date_from_unix_date(F.lit(seconds // 86400))
    if start is not None:
        rows = rows.where(F.col("day") >= day(start))
    if end is not None:
        rows = rows.where(F.col("day") <= day(end))
    blocks = split_frames(rows).where(F.col("param").rlike(glob_pattern(scope)))
    blocks = blocks if start is None else blocks.where(F.col("poll_ts") >= start)
    return blocks if end is None else blocks.where(F.col("poll_ts") <= end)
