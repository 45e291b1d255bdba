"""Live polls: logged blocks as a stream, merged, turned into rates, fanned out.

Blocks of a poll may arrive in several files, so polls are merged behind a
watermark. Rates need the poll just before: each micro-batch stores the rows of
its last poll as a small table under the checkpoint, and the next batch reads
it. A batch that is run again after a failure reads and writes the same tables.
With ``keyed`` state the last counters of each job stay in the state store
instead, and a batch stores no more than the time of its last poll.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from jobtally.functions.layout import JobIdLayout
from jobtally.operators import merge, peaks, rates, shares, skew
from jobtally.sinks.ledger import SinkLedger
from jobtally.sinks.peaks import PeakStore
from jobtally.sinks.points import fan_out, must
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.raw_log import stream_raw_log
from jobtally.streaming import state as keyed_state

Sink = Callable[[DataFrame, int], None]


def stream_merge(
    blocks: DataFrame,
    delay: str = "30 seconds",
    layout: JobIdLayout | None = None,
    groupby: str = "none",
    include_bytes: bool = False,
) -> DataFrame:
    """One row per poll and job, emitted once the watermark has passed the poll.

    A poll without jobs gives a row with a null job: it still took place.
    """
    samples = parse_job_stats(blocks, keep_empty=True)
    return merge.job_table(samples.withWatermark("poll_time", delay), layout, groupby, include_bytes)


class RateFeed:
    """Turns merged polls into rates, batch by batch, for ``foreachBatch``.

    A new ``state`` folder starts without a reference poll; use one per
    checkpoint. ``failed`` holds the sinks that failed in the latest batch. A
    failure ends the batch, after all sinks had their turn, so that it is run
    again, by the sinks that failed; a ledger under ``state`` tells which have it.
    With ``go_on`` failures are only
    logged and the rows are lost to that sink. ``counters`` are sinks for the
    merged polls themselves, which need no second pass over the logs.
    """

    def __init__(
        self,
        state: str,
        sinks: Mapping[str, Sink],
        mode: str = "rate",
        go_on: bool = False,
        counters: Mapping[str, Sink] | None = None,
    ):
        self.counters = dict(counters or {})
        if shared := self.counters.keys() & sinks.keys():
            raise ValueError(f"sinks of rates and of counters share the names {sorted(shared)}")
        self.go_on = go_on
        self.state = state.rstrip("/")
        self.ledger = SinkLedger(f"{self.state}/ledger")
        self.sinks = sinks
        self.mode = mode
        self.failed: dict[str, Exception] = {}

    def _slot(self, batch_id: int) -> str:
        """Where a batch keeps its reference: three folders are used in turn, so
        a batch never writes over what it or its re-run reads."""
        return f"{self.state}/slot={batch_id % 3}"

    def _store(self, rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(self._slot(batch_id))

    def reference(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Rows of the last poll before a batch, None if there was none."""
        try:
            kept = spark.read.parquet(self._slot(batch_id - 1))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return kept.where(F.col("_batch") == batch_id - 1).drop("_batch", "slot")

    def has_reference(self, spark: SparkSession, batch_id: int) -> bool:
        before = self.reference(spark, batch_id)
        return before is not None and not before.where("job_id IS NOT NULL").isEmpty()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.reference(batch.sparkSession, batch_id)
        rows = (batch if before is None else before.unionByName(batch)).persist()
        try:
            register = merge.poll_register(rows)
            numbered = merge.with_poll_numbers(rows.drop("poll_time").where("job_id IS NOT NULL"), register)
            changed = rates.job_rates(numbered, self.mode)
            self._give(changed, batch.where("job_id IS NOT NULL") if self.counters else None, batch_id)
            last = rows.select(F.max("poll_ts")).scalar()
            self._store(rows.where(F.col("poll_ts") == last), batch_id)
        finally:
            rows.unpersist()

    def _give(self, changed: DataFrame, counters: DataFrame | None, batch_id: int) -> None:
        """Give rows to the sinks that do not have this batch yet."""
        spark = changed.sparkSession
        self.failed = fan_out(changed, self.ledger.bound(spark, self.sinks, batch_id))
        if counters is not None:
            self.failed |= fan_out(counters, self.ledger.bound(spark, self.counters, batch_id))
        if not self.go_on:
            must(self.failed)
        self.ledger.trim(spark, batch_id)

    def reset(self, spark: SparkSession, batch_id: int) -> None:
        """Forget the reference, so that ``batch_id`` starts over."""
        self.ledger.forget(spark, batch_id)
        before = self.reference(spark, batch_id)
        if before is not None:
            self._store(spark.createDataFrame([], before.schema), batch_id - 1)


def adjacent(changes: DataFrame, polls: DataFrame) -> DataFrame:
    """Rates from rows of ``job_changes``: those since the poll just before, of all polls in ``polls`` (poll_ts)."""
    register = merge.poll_register(polls)
    before = register.select((F.col("poll") + 1).alias("poll"), F.col("poll_ts").alias("since"))
    pairs = register.join(before, "poll")
    found = changes.where("sampling_window > 0 AND job_id IS NOT NULL").drop("poll_time")
    rated = skew.salted_join(found, pairs, ["poll_ts", "since"], "job_id")
    names = merge.operation_columns(changes)
    return rated.select("poll", "poll_ts", "job_id", "sampling_window", "query_duration", *names)


class KeyedRateFeed(RateFeed):
    """Turns a stream of ``state.job_changes`` into rates, for ``foreachBatch``.

    The counters of the poll before are in the state of each job, so a batch
    reads one row from its predecessor: the time of the last poll.
    """

    def has_reference(self, spark: SparkSession, batch_id: int) -> bool:
        before = self.reference(spark, batch_id)
        return before is not None and not before.isEmpty()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        before = self.reference(batch.sparkSession, batch_id)
        changes = batch.persist()
        try:
            polls = changes.select("poll_ts").distinct()
            polls = polls if before is None else polls.unionByName(before)
            self._give(adjacent(changes, polls), None, batch_id)
            self._store(polls.agg(F.max("poll_ts").alias("poll_ts")).where("poll_ts IS NOT NULL"), batch_id)
        finally:
            changes.unpersist()


def point_stream(merged: DataFrame) -> DataFrame:
    """Merged polls of a stream as points that keep their event time.

    Rows of empty polls have no values. A filter on the job would be pushed below
    the watermark, which then would not see those polls.
    """
    points = merge.to_long(merged)
    return points.select("poll_time", F.col("poll_ts").alias("timestamp"), "job_id", "operation", "value")


def batch_table(path: str) -> Sink:
    """A sink that keeps each batch in its own folder, replaced on a re-run."""
    return lambda df, batch_id: df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def peak_store(path: str, fold_every: int = 20) -> Sink:
    """A sink that keeps all-time peaks of the rates, read by ``PeakStore(path).read``."""
    store = PeakStore(path, fold_every)

    def write(rate_table: DataFrame, batch_id: int) -> None:
        store.add(peaks.peak_ops(shares.totals(rate_table)), peaks.peak_jobs(rate_table), batch_id)

    return write


def long_points(write: Callable[[DataFrame, str, str], None], path: str) -> Sink:
    """A sink for exporters: a wide table as points.

    ``write`` is one of the point writers (rows, path, mode). Each batch has a
    folder of its own below ``path``, replaced on a re-run.
    """

    def points(table: DataFrame, batch_id: int) -> None:
        rows = merge.to_long(table).select(F.col("poll_ts").alias("timestamp"), "job_id", "operation", "value")
        write(rows, f"{path}/batch_id={batch_id}", "overwrite")

    return points


def every_batch(sinks: Mapping[str, Sink], go_on: bool = False, ledger: str | None = None) -> Sink:
    """Give each micro-batch to several sinks; one that fails stops no other.

    The batch then fails, to be run again, unless ``go_on`` lets it pass. With a
    ``ledger`` folder, one per checkpoint, only the sinks that failed take it again.
    """
    notes = SinkLedger(ledger) if ledger else None

    def write(df: DataFrame, batch_id: int) -> None:
        if notes:
            due = notes.bound(df.sparkSession, sinks, batch_id)
        else:
            due = {name: (lambda rows, sink=sink: sink(rows, batch_id)) for name, sink in sinks.items()}
        failed = fan_out(df, due)
        if not go_on:
            must(failed)
        if notes:
            notes.trim(df.sparkSession, batch_id)

    return write


def writer(stream: DataFrame, batch: Sink, checkpoint: str, interval: int | None = 10) -> DataStreamWriter:
    """A writer that runs every ``interval`` seconds, or over what is there with None."""
    out = stream.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if interval is None else out.trigger(processingTime=f"{interval} seconds")


def live_rates(
    spark: SparkSession,
    folder: str,
    base: str,
    sinks: Mapping[str, Sink],
    mode: str = "rate",
    delay: str = "30 seconds",
    interval: int | None = 10,
    layout: JobIdLayout | None = None,
    groupby: str = "none",
    include_bytes: bool = False,
    counters: Mapping[str, Sink] | None = None,
    keyed: bool = False,
) -> StreamingQuery:
    """Start the whole live view: logs in a folder to rates in every sink, and merged polls in those of ``counters``.

    ``keyed`` keeps the last counters of each job in the state store; counters
    then have no sinks, as the stream holds changes only.

    Checkpoint and reference polls are kept below ``base``, a folder that every
    executor and a restarted driver can reach, so that the latter goes on where
    the lost one stopped.
    """
    base = base.rstrip("/")
    if not base:
        raise ValueError("live rates need a folder for their checkpoint")
    merged = stream_merge(stream_raw_log(spark, folder), delay, layout, groupby, include_bytes)
    if keyed and counters:
        raise ValueError("a keyed feed has no counters to give")
    if keyed:
        merged = keyed_state.job_changes(merged, mode)
        batch: Sink = KeyedRateFeed(f"{base}/reference", sinks, mode)
    else:
        batch = RateFeed(f"{base}/reference", sinks, mode, counters=counters)
    return writer(merged, batch, f"{base}/checkpoint", interval).start()


def live_series(
    spark: SparkSession,
    folder: str,
    base: str,
    gone: Sink,
    window: int = 300,
    count: int = 1000,
    delay: str = "30 seconds",
    interval: int | None = 10,
    layout: JobIdLayout | None = None,
    groupby: str = "none",
) -> StreamingQuery:
    """Start a view of the newest points of each series: ``count`` at most, none older than twice the ``window``.

    ``state.held`` reads what it holds from the checkpoint below ``base``; what
    leaves goes to ``gone``.
    """
    base = base.rstrip("/")
    points = point_stream(stream_merge(stream_raw_log(spark, folder), delay, layout, groupby))
    return writer(keyed_state.retain(points, count, 2 * window), gone, f"{base}/checkpoint", interval).start()


def repeats_needed(repeats: int, mode: str) -> int:
    """Iterations to run: rates and differences need two polls at least."""
    return 2 if mode in ("rate", "diff") and repeats == 1 else repeats


def run_batches(query: StreamingQuery, repeats: int, poll: float = 0.2) -> None:
    """Let a query finish ``repeats`` micro-batches and stop it; -1 waits for its end."""
    if repeats < 0:
        query.awaitTermination()
        return
    while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] < repeats - 1):
        time.sleep(poll)
    query.stop()
