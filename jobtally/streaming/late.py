"""Blocks that come after the watermark: kept aside as they arrive, and merged into their polls afterwards.

The stream's aggregation drops them without a trace. So the blocks travel beside the merged polls in the same query, and
each micro-batch stores those that the aggregation has just dropped, by the rule it follows: a row is late if its time is
not after the watermark of the batch before. Merging is addition, hence polls as they are now are the stored polls plus
the late blocks, summed again. A repair recomputes the rates of the polls that late blocks belong to and of the poll after
each; readers take its rows in place of the first ones.

Below the base folder: ``polls`` (merged polls, by batch and day), ``late`` (blocks, by batch), ``repairs`` (rates and the
polls they replace, by the last batch of late blocks they cover), ``reference`` and ``checkpoint``. Folders are written
whole and by number, so a batch or a repair that runs again replaces what its first try left.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtally.functions.layout import JobIdLayout
from jobtally.operators import merge, rates
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.raw_log import stream_raw_log
from jobtally.streaming.feed import RateFeed, Sink, stream_merge, writer

BLOCK = ["host", "param", "poll_time", "poll_ts", "data"]
DAY = "poll_ts div 86400L"


def with_arrivals(blocks: DataFrame, delay: str, layout: JobIdLayout | None = None, groupby: str = "none", include_bytes: bool = False) -> DataFrame:
    """``stream_merge`` of a stream of blocks, and beside its rows every block as it arrives, in the column ``block``."""
    merged = stream_merge(blocks, delay, layout, groupby, include_bytes)
    arrived = blocks.select(F.struct(*BLOCK).alias("block"))
    return merged.unionByName(arrived, allowMissingColumns=True)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class LateFeed(RateFeed):
    """A ``RateFeed`` for ``with_arrivals`` that stores merged polls and late blocks below ``base``."""

    def __init__(self, base: str, sinks: Mapping[str, Sink], delay_ms: int, mode: str = "rate", go_on: bool = False):
        self.base, self.delay_ms = base.rstrip("/"), delay_ms
        super().__init__(f"{self.base}/reference", sinks, mode, go_on)

    def _seen(self, spark: SparkSession, batch_id: int) -> tuple[int | None, int | None]:
        """The newest time that batches up to the one before, and up to two before, had seen."""
        stored = _read(spark, f"{self.base}/seen/slot={(batch_id - 1) % 3}")
        row = None if stored is None else stored.where(F.col("batch") == batch_id - 1).first()
        return (None, None) if row is None else (row["newest"], row["newest_before"])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, newest_before = self._seen(spark, batch_id)
        blocks = batch.where("block IS NOT NULL").select("block.*")
        at = F.unix_millis("poll_time")
        # The aggregation drops by the watermark of the batch before, which two batches ago gave rise to.
        if newest_before is not None:
            late = blocks.where(at <= newest_before - self.delay_ms)
            if not late.isEmpty():
                late.write.mode("overwrite").parquet(f"{self.base}/late/batch_id={batch_id}")
        merged = batch.where("block IS NULL").drop("block").persist()
        try:
            merged.selectExpr("*", f"{DAY} AS day").write.mode("overwrite").partitionBy("day").parquet(f"{self.base}/polls/batch_id={batch_id}")
            super().__call__(merged, batch_id)
        finally:
            merged.unpersist()
        here = blocks.agg(F.max(at).alias("t")).first()["t"]
        now = max((t for t in (newest, here) if t is not None), default=None)
        seen = spark.createDataFrame([(batch_id, now, newest)], "batch long, newest long, newest_before long")
        seen.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/seen/slot={batch_id % 3}")


def late_blocks(spark: SparkSession, base: str) -> DataFrame | None:
    """Blocks that came late, with the batch they came in; None if there are none."""
    return _read(spark, f"{base}/late")


def merged_polls(
    spark: SparkSession, base: str, layout: JobIdLayout | None = None, groupby: str = "none", include_bytes: bool = False
) -> DataFrame:
    """Merged polls as they are now: what the stream gave, and late blocks added to it.

    Counts are sums and times are maxima, so both are merged again by the same rule.
    """
    polls = spark.read.parquet(f"{base}/polls").drop("batch_id")
    late = late_blocks(spark, base)
    if late is None:
        return polls
    samples = parse_job_stats(late.drop("batch_id"), keep_empty=True)
    both = polls.unionByName(merge.job_table(samples, layout, groupby, include_bytes).selectExpr("*", f"{DAY} AS day"))
    names = merge.operation_columns(polls)
    return both.groupBy("day", "poll_ts", "poll_time", "job_id").agg(
        *[F.max(name).alias(name) for name in merge.TIMES], *[F.sum(name).cast("bigint").alias(name) for name in names]
    )


def repair(
    spark: SparkSession,
    base: str,
    mode: str = "rate",
    layout: JobIdLayout | None = None,
    groupby: str = "none",
    include_bytes: bool = False,
) -> bool:
    """Recompute the rates that late blocks since the last repair have changed; False if there are none.

    Only the days of the polls concerned are read, and of those only the polls and the ones beside them are compared.
    """
    base = base.rstrip("/")
    late = late_blocks(spark, base)
    if late is None:
        return False
    done = _read(spark, f"{base}/repairs")
    through = -1 if done is None else done.agg(F.max("through")).first()[0]
    news = late.where(F.col("batch_id") > through)
    last = news.agg(F.max("batch_id")).first()[0]
    if last is None:
        return False
    polls = merged_polls(spark, base, layout, groupby, include_bytes)
    register = merge.poll_register(polls.select("poll_ts"))
    changed = register.join(news.select("poll_ts").distinct(), "poll_ts", "left_semi")
    around = changed.select(F.explode(F.array(*[F.col("poll") + n for n in (-1, 0, 1)])).alias("poll")).distinct()
    needed = register.join(around, "poll").persist()
    try:
        days = needed.selectExpr(f"min({DAY})", f"max({DAY})").first()
        some = polls.where(F.col("day").between(*days) & F.col("job_id").isNotNull())
        table = some.join(needed, "poll_ts").drop("day", "poll_time")
        after = changed.select(F.explode(F.array("poll", F.col("poll") + 1)).alias("poll")).distinct()
        affected = needed.join(after, "poll", "left_semi")
        # A poll without rates has a row all the same, which says that the first ones are void.
        found = affected.join(rates.job_rates(table, mode).drop("poll_ts"), "poll", "left").drop("poll")
        found.write.mode("overwrite").parquet(f"{base}/repairs/through={last}")
    finally:
        needed.unpersist()
    return True


def corrected(spark: SparkSession, base: str, first: DataFrame) -> DataFrame:
    """Rates with those of repaired polls in place of the ``first`` ones; the latest repair of a poll counts."""
    done = _read(spark, f"{base.rstrip('/')}/repairs")
    if done is None:
        return first
    latest = done.groupBy("poll_ts").agg(F.max("through").alias("through"))
    names = [name for name in first.columns if name in done.columns]
    kept = first.select(*names).join(latest, "poll_ts", "left_anti")
    return kept.unionByName(done.join(latest, ["poll_ts", "through"], "left_semi").where("job_id IS NOT NULL").select(*names))


def live_rates_with_repair(
    spark: SparkSession,
    folder: str,
    base: str,
    sinks: Mapping[str, Sink],
    mode: str = "rate",
    delay_seconds: int = 30,
    interval: int | None = 10,
    layout: JobIdLayout | None = None,
    groupby: str = "none",
    include_bytes: bool = False,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """``feed.live_rates`` that loses no block: run ``repair`` on its base from time to time, and read ``corrected``."""
    base = base.rstrip("/")
    blocks = stream_raw_log(spark, folder, files_per_batch)
    stream = with_arrivals(blocks, f"{delay_seconds} seconds", layout, groupby, include_bytes)
    return writer(stream, LateFeed(base, sinks, 1000 * delay_seconds, mode), f"{base}/checkpoint", interval).start()
