"""Writers of points and dumps, optionally bounded in file size."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtally.functions.formats import PROMETHEUS_HEADER, json_line, millis, prometheus_line
from jobtally.functions.sizes import parse_size
from jobtally.operators.skew import CHUNK_SECONDS
from jobtally.session import importable
from jobtally.sources.raw_log import frame_text, log_day, target_kind

log = logging.getLogger(__name__)

# Rough size of one stored point, for a bound on files that are compressed.
PARQUET_POINT_BYTES = 16
LARGEST_FILE = 128 << 20  # of text that is bounded


def _packed(bound: int, header: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines as the texts of whole files: each as many as fit below the bound with the header, one at least."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([header + "\n".join(held)], pa.string())], ["value"])

        start = len(header.encode())
        held: list[str] = []
        size = start
        for batch in batches:
            lines = pc.fill_null(batch.column(0), "")
            for line, length in zip(lines.to_pylist(), pc.binary_length(lines).to_pylist(), strict=True):
                if held and size + length + 1 > bound:
                    yield full()
                    held, size = [], start
                held.append(line)
                size += length + 1
        if held:
            yield full()

    return pack


def _text(lines: DataFrame, path: str, mode: str, max_size: str | None, header: str = "") -> None:
    """Write lines in one pass. With a bound every file but the last of a task is within a line of it, and none above.

    A bounded file is put together in memory, hence no larger than ``LARGEST_FILE``. A line longer than the bound is a
    file of its own.
    """
    if max_size:
        importable(lines.sparkSession)
        files = lines.select("value").mapInArrow(_packed(min(parse_size(max_size), LARGEST_FILE), header), "value string")
        files.write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    else:
        headed = lines.select(_with_header(F.col("value"), header).alias("value")) if header else lines
        headed.write.mode(mode).text(path)


def write_raw_log(blocks: DataFrame, path: str, mode: str = "append", max_size: str | None = None) -> None:
    """Blocks as framed text."""
    lines = blocks.select(frame_text(blocks).alias("value"))
    _text(lines, path, mode, max_size)


def write_log_store(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Blocks as framed text in folders by day, kind of target and host, for ``raw_log.read_log_store``.

    Rebalancing keeps few files per folder and cuts large ones by size at run time.
    """
    rows = blocks.select(
        frame_text(blocks).alias("value"), log_day("poll_ts").alias("day"), target_kind("param").alias("kind"), F.col("host").alias("server")
    )
    rows.hint("rebalance", "day", "kind", "server").write.mode(mode).partitionBy("day", "kind", "server").text(path)


_ONE_AT_A_TIME = threading.Lock()


@contextmanager
def _stored_in_millis(df: DataFrame) -> Iterator[None]:
    """Write times as whole milliseconds, as other readers of the format expect.

    Only a setting of the session says so. Writers of points take turns, so that none sees it half way; other writes of
    the session should not run beside them. Streams have a session of their own for each batch.
    """
    conf, key = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    with _ONE_AT_A_TIME:
        before = conf.get(key)
        conf.set(key, "TIMESTAMP_MILLIS")
        try:
            yield
        finally:
            conf.set(key, before)


def write_points_parquet(points: DataFrame, path: str, mode: str = "append", max_size: str | None = None) -> None:
    """Points as Parquet, one folder per day so that time filters skip files.

    Rebalancing joins small days and splits large ones by size at run time: few
    files per day, and no day bound to a single task.
    """
    rows = points.dropna(subset=["timestamp", "job_id", "operation", "value"]).select(
        F.timestamp_seconds("timestamp").alias("timestamp"), "job_id", "operation", "value",
        F.date_from_unix_date(F.expr("CAST(timestamp div 86400 AS INT)")).alias("date"),
    )
    writer = rows.hint("rebalance", "date").write.mode(mode).option("compression", "snappy")
    if max_size:
        writer = writer.option("maxRecordsPerFile", max(1, parse_size(max_size) // PARQUET_POINT_BYTES))
    with _stored_in_millis(points):
        writer.partitionBy("date").parquet(path)


def _with_header(line: Column, header: str) -> Column:
    """Put a header before the first row of each task, hence of its file.

    The low 33 bits of the generated id count the rows of a task.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    return F.when(at == 0, F.concat(F.lit(header), line)).otherwise(line)


def write_prometheus(
    points: DataFrame, path: str, mode: str = "append", max_size: str | None = None, header: bool = True
) -> None:
    """Points as exposition text, the metric described once per file."""
    lines = points.select(prometheus_line().alias("value"))
    _text(lines, path, mode, max_size, PROMETHEUS_HEADER if header else "")


def victoriametrics_lines(points: DataFrame, per_series: bool = False) -> DataFrame:
    """JSON lines, one per point, or one per series and day."""
    if not per_series:
        return points.select(
            json_line(F.array("value"), F.array(millis(F.col("timestamp")))).alias("value")
        )
    series = (
        points.withColumn("_day", F.expr(f"timestamp div {CHUNK_SECONDS}"))
        .groupBy("job_id", "operation", "_day")
        .agg(F.sort_array(F.collect_list(F.struct("timestamp", "value"))).alias("p"))
    )
    times = F.transform("p.timestamp", millis)
    return series.select(json_line(F.col("p.value"), times).alias("value"))


def write_victoriametrics(
    points: DataFrame, path: str, mode: str = "append", max_size: str | None = None, per_series: bool = False
) -> None:
    lines = victoriametrics_lines(points, per_series)
    _text(lines, path, mode, max_size)


WRITERS = {
    "parquet": write_points_parquet,
    "prometheus": write_prometheus,
    "victoriametrics": write_victoriametrics,
}


def fan_out(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]]) -> dict[str, Exception]:
    """Give the same rows to several sinks; one that fails does not stop the rest.

    Returns the failures by sink name; ``must`` raises what they hold.
    """
    failed: dict[str, Exception] = {}
    df = df.persist()
    try:
        for name, write in sinks.items():
            try:
                write(df)
            except Exception as error:  # noqa: BLE001 - reported to the caller
                log.warning("sink %s failed: %s", name, error)
                failed[name] = error
    finally:
        df.unpersist()
    return failed


class SinksFailed(RuntimeError):
    """Some sinks failed; the others have the rows."""


def must(failed: Mapping[str, Exception]) -> None:
    """Raise if any sink failed, so that whoever gave the rows gives them again."""
    if failed:
        raise SinksFailed(", ".join(f"{name}: {error}" for name, error in failed.items())) from next(iter(failed.values()))
