"""Keyed state of live series: the last counters of each job, and the newest points of each series.

State lies in RocksDB, a few rows per key under a schema of its own; a micro-batch touches the keys it has rows for and
no others. Both processors take the rows of a key in the order of their polls, as ``feed.stream_merge`` emits them, and
both drop a key some time after its last poll, by timers in event time, so that a run that is repeated does the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from jobtally.operators.merge import operation_columns
from jobtally.session import ROCKSDB, STATE_STORE, importable

KEEP_JOB = 3600  # seconds after its last poll until a job is forgotten


def needs_rocksdb(spark: SparkSession) -> None:
    """Fail before a stream starts if the session keeps state elsewhere; workers need the processors, too."""
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        raise RuntimeError(f"set {STATE_STORE} to {ROCKSDB}")
    importable(spark)


def _longs(*names: str) -> list[StructField]:
    return [StructField(name, LongType()) for name in names]


class JobChanges(StatefulProcessor):
    """Changes of one job's counters since the poll before in which it was seen."""

    def __init__(self, names: list[str], mode: str, keep: int):
        self.names, self.mode, self.keep = names, mode, keep
        self.row = Row("poll_time", "poll_ts", "job_id", "since", "sampling_window", "query_duration", *names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType(_longs("poll_ts", "snapshot_time", *self.names)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.last.get()
        before = None if known is None else list(known)
        for row in sorted(rows, key=lambda r: r["poll_ts"]):
            now = [row["poll_ts"], row["snapshot_time"], *[row[name] for name in self.names]]
            if key[0] is not None and before is not None and now[0] <= before[0]:
                continue  # only a repeat of a poll could come here
            yield self._change(key[0], row["poll_time"], before, now)
            before = now
        if key[0] is None:
            return  # polls without jobs are passed on and leave no state
        if known is None:
            self.handle.registerTimer((before[0] + self.keep) * 1000)
        self.last.update(tuple(before))

    def _change(self, job_id: str | None, poll_time: Any, before: list | None, now: list) -> Row:
        window = None if before is None else now[1] - before[1]
        values: list[int | None] = [None] * len(self.names)
        if before is not None and window > 0:
            for at, (old, new) in enumerate(zip(before[2:], now[2:], strict=True)):
                if old is not None:
                    grown = max((new or 0) - old, 0)
                    values[at] = grown if self.mode == "diff" else grown // window
        since = None if before is None else before[0]
        return self.row(poll_time, now[0], job_id, since, window, None if since is None else now[0] - since, *values)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Forget a job that was not seen for long; else look again when that could be so."""
        last = self.last.get()
        if last is not None:
            due = (last[0] + self.keep) * 1000
            if due <= timerValues.getCurrentWatermarkInMs():
                self.last.clear()
            else:
                self.handle.registerTimer(due)
        return iter(())

    def close(self) -> None:
        pass


def job_changes(merged: DataFrame, mode: str = "rate", keep: int = KEEP_JOB) -> DataFrame:
    """One row per row of a stream of merged polls, with the changes since the job's row before.

    ``since`` is the poll of that row, null at first. Whether it was the poll just before, only the list of all polls
    can tell: see ``feed.KeyedRateFeed``. A job whose snapshot time did not move has no changes.
    """
    if mode not in ("rate", "diff"):
        raise ValueError(f"mode must be 'rate' or 'diff', not {mode!r}")
    needs_rocksdb(merged.sparkSession)
    names = operation_columns(merged)
    out = StructType(
        [
            StructField("poll_time", merged.schema["poll_time"].dataType),
            *_longs("poll_ts"),
            StructField("job_id", StringType()),
            *_longs("since", "sampling_window", "query_duration", *names),
        ]
    )
    return merged.groupBy("job_id").transformWithState(JobChanges(names, mode, keep), out, "Append", "EventTime", eventTimeColumnName="poll_time")


class Retention(StatefulProcessor):
    """The newest points of one series in a ring, none older than an age.

    The ring has a slot per point, so a new point costs one slot however many are held; old ones leave at its tail.
    """

    def __init__(self, count: int, age: int):
        self.count, self.age = count, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", StructType(_longs("first", "next", "newest")))
        self.ring = handle.getMapState("ring", StructType(_longs("slot")), StructType(_longs("timestamp", "value")))

    def _gone(self, key: Any, point: Any, why: str) -> Row:
        return Row(timestamp=point[0], job_id=key[0], operation=key[1], value=point[1], why=why)

    def _drop_old(self, key: Any, first: int, following: int, cutoff: int) -> tuple[int, list[Row]]:
        gone = []
        while first < following:
            slot = (first % self.count,)
            point = self.ring.getValue(slot)
            if point[0] >= cutoff:
                break
            gone.append(self._gone(key, point, "age"))
            self.ring.removeKey(slot)
            first += 1
        return first, gone

    def _cutoff(self, timerValues: Any) -> int:
        return timerValues.getCurrentWatermarkInMs() // 1000 - self.age

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, following, newest = self.ends.get() or (0, 0, None)
        idle = first == following
        cutoff = self._cutoff(timerValues)
        first, gone = self._drop_old(key, first, following, cutoff)
        for row in sorted(rows, key=lambda r: (r["timestamp"], r["value"])):
            point = (row["timestamp"], row["value"])
            if point[0] < cutoff or (newest is not None and point[0] <= newest):
                gone.append(self._gone(key, point, "late"))
                continue
            slot = (following % self.count,)
            if following - first == self.count:
                gone.append(self._gone(key, self.ring.getValue(slot), "count"))
                first += 1
            self.ring.updateValue(slot, point)
            following, newest = following + 1, point[0]
        if newest is not None:
            self.ends.update((first, following, newest))
        if idle and first < following:
            self._wake(first)
        yield from gone

    def _wake(self, first: int) -> None:
        self.handle.registerTimer((self.ring.getValue((first % self.count,))[0] + self.age) * 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first, following, newest = self.ends.get()
        first, gone = self._drop_old(key, first, following, self._cutoff(timerValues))
        if first < following:
            self.ends.update((first, following, newest))
            self._wake(first)
        else:
            self.ends.clear()
            self.ring.clear()
        yield from gone

    def close(self) -> None:
        pass


LEFT = "timestamp BIGINT, job_id STRING, operation STRING, value BIGINT, why STRING"


def retain(points: DataFrame, count: int, age: int) -> DataFrame:
    """Hold the newest ``count`` points of each series, none more than ``age`` seconds behind the watermark.

    ``points`` is a stream of (timestamp, job_id, operation, value) with an event time, in order of time within a
    series. The result is what leaves: ``why`` says by count, by age, or late, if a point came after a newer one. What
    is held is read by ``held``.
    """
    if count < 1 or age < 0:
        raise ValueError("count must be at least 1 and age not negative")
    needs_rocksdb(points.sparkSession)
    return points.groupBy("job_id", "operation").transformWithState(Retention(count, age), LEFT, "Append", "EventTime")


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The points a stream of ``retain`` holds now: (timestamp, job_id, operation, value), read from its state."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    ours = operators.where("operatorName LIKE 'transformWithState%'").agg(F.max("operatorId")).first()[0]
    state = spark.read.format("statestore").option("operatorId", ours).option("stateVarName", "ring").load(checkpoint)
    return state.select(
        F.col("user_map_value.timestamp"), F.col("key.job_id"), F.col("key.operation"), F.col("user_map_value.value")
    )
