"""Late blocks: the stream and its repairs together give what a batch over all logs gives."""

import os

import pytest
from conftest import framed
from pyspark.sql import functions as F
from test_streaming import COLUMNS, POLLS, batch_table, log_of

from jobtally.operators import merge, rates
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.raw_log import read_raw_log
from jobtally.streaming import feed, late


@pytest.fixture(scope="module")
def spark(spark):
    """Few partitions: batches are small here and many."""
    few = spark.newSession()
    few.conf.set("spark.sql.shuffle.partitions", "2")
    return few


class Site:
    def __init__(self, spark, rows, folder):
        self.spark, self.rows, self.folder = spark, rows, folder
        self.logs, self.base, self.out = folder / "logs", str(folder / "base"), str(folder / "rates")
        self.logs.mkdir()
        self.n = 0

    def arrive(self, *texts):
        for text in texts:
            path = self.logs / f"{self.n:04}.raw"
            path.write_text(text)
            os.utime(path, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
            self.n += 1

    def run(self, files=4):
        query = late.live_rates_with_repair(
            self.spark, str(self.logs), self.base, {"t": feed.batch_table(self.out)}, delay_seconds=5, interval=None, files_per_batch=files
        )
        assert query.awaitTermination(300) and query.exception() is None
        return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

    def check(self):
        first = self.spark.read.parquet(self.out)
        found = late.corrected(self.spark, self.base, first)
        table = batch_table(self.spark, str(self.logs))
        expected = rates.job_rates(table)
        assert self.rows(found, *COLUMNS) == self.rows(expected, *COLUMNS)
        polls = late.merged_polls(self.spark, self.base).where("job_id IS NOT NULL")
        columns = ["poll_ts", "job_id", "snapshot_time", "ops", "open"]
        assert self.rows(polls, *columns) == self.rows(table.where("job_id IS NOT NULL"), *columns)
        return self.rows(first, *COLUMNS) != self.rows(expected, *COLUMNS)


def end(minute):
    return framed("oss0", "p", f"2024-01-01T00:{minute:02}:00+00:00", "job_stats:\n")


@pytest.fixture
def site(spark, rows, tmp_path):
    return Site(spark, rows, tmp_path)


def test_stream_and_repairs_equal_batch(spark, site):
    """Late by one poll, by many, a whole poll that is late, an empty one, one before all others, and late again after a repair."""
    logs = {(poll, host): log_of(poll, host) for poll in range(POLLS) for host in range(2)}
    held = [(0, 0), (0, 1), (3, 1), (4, 0), (4, 1), (6, 0), (6, 1), (8, 0)]
    site.arrive(*[text for key, text in sorted(logs.items()) if key not in held], end(5))
    assert site.run() == 0
    assert not late.repair(spark, site.base) and late.late_blocks(spark, site.base) is None
    site.arrive(*[logs[key] for key in ((3, 1), (8, 0), (6, 0), (6, 1))])
    site.run()
    assert late.repair(spark, site.base)
    assert not late.repair(spark, site.base)  # nothing new
    site.check()
    site.arrive(*[logs[key] for key in ((4, 1), (0, 0), (0, 1), (4, 0))], end(6), end(7))
    site.run(2)
    assert late.repair(spark, site.base)
    assert site.check()  # it had changed something
    came = late.late_blocks(spark, site.base).groupBy().agg(F.count("*")).first()[0]
    assert came == len(held)
    repairs = spark.read.parquet(f"{site.base}/repairs")
    assert repairs.select("through").distinct().count() == 2
    last = repairs.agg(F.max("through")).first()[0]
    assert 0 < repairs.where(F.col("through") == last).select("poll_ts").distinct().count() <= 4  # two polls and those after them


def test_what_is_late_is_what_the_aggregation_drops(spark, site):
    """Blocks around the watermark, batch by batch of one file: none is lost, none counts twice."""
    order = [0, 1, 2, 0, 5, 1, 4, 3, 5, 7, 6, 2, 9]
    seen = set()
    for poll in order:
        host = int((poll, 0) in seen)
        seen.add((poll, host))
        site.arrive(log_of(poll, host))
    site.arrive(end(5))
    dropped = site.run(1)
    blocks = late.late_blocks(spark, site.base)
    assert dropped > 0 and blocks is not None
    late.repair(spark, site.base)
    site.check()


def test_a_batch_that_runs_again_stores_late_blocks_once(spark, site, rows):
    kind = "struct<host:string,param:string,poll_time:timestamp,poll_ts:bigint,data:string>"
    site.arrive(log_of(0, 0), log_of(5, 0))
    blocks = read_raw_log(spark, str(site.logs))
    merged = merge.job_table(parse_job_stats(blocks, keep_empty=True)).withColumn("block", F.lit(None).cast(kind))
    arrived = blocks.select(F.struct(*late.BLOCK).alias("block"))
    handler = late.LateFeed(site.base, {}, 5000)
    batches = [
        arrived.where("block.poll_ts % 100 = 50"),
        arrived.where("false"),
        arrived.where("block.poll_ts % 100 = 0"),
    ]
    for n, rows_of in enumerate(batches):
        batch = merged.where("false").unionByName(rows_of, allowMissingColumns=True)
        for _ in range(2):
            handler(batch, n)
    assert late.late_blocks(spark, site.base).count() == 1
