"""Dumps cut at job headers parse as whole blocks do, wherever splits fall."""

import random

import pytest
from conftest import POLL_1, POLL_2, TIME_1, TIME_2, framed
from pyspark.sql import functions as F

from jobtally.operators.merge import poll_register
from jobtally.sources.dumps import parse_job_stats
from jobtally.sources.large_dumps import read_large_logs
from jobtally.sources.raw_log import read_raw_log

COLUMNS = ["host", "param", "poll_ts", "job_id", "snapshot_time", "operation", "samples", "unit"]


@pytest.fixture
def cut(spark):
    """A session that reads files in splits of so many bytes."""

    def session(size):
        other = spark.newSession()
        for key, value in {"maxPartitionBytes": size, "openCostInBytes": 1, "minPartitionNum": 1}.items():
            other.conf.set(f"spark.sql.files.{key}", str(value))
        return other

    return session


def check(rows, cut, spark, path, sizes):
    expected = rows(parse_job_stats(read_raw_log(spark, path)), *COLUMNS)
    for size in sizes:
        found = read_large_logs(cut(size), path)
        assert rows(parse_job_stats(found), *COLUMNS) == expected, size
        assert rows(found.select("poll_ts").distinct()) == rows(read_raw_log(spark, path).select("poll_ts").distinct())
    return expected


def test_pieces_of_every_size(spark, rows, cut, tmp_path):
    empty = "job_stats:\n"
    text = (
        framed("oss1", "obdfilter.x.job_stats", TIME_1, POLL_1)
        + framed("mds1", "mdt.x.job_stats", TIME_1, empty)
        + framed("oss2", "obdfilter.y.job_stats", TIME_1, POLL_1 * 5)
        + framed("oss1", "obdfilter.x.job_stats", "no time", POLL_2)
        + framed("oss1", "obdfilter.x.job_stats", TIME_2, POLL_2 + "  - job_id: indented\n    open: { samples: 4 }\n")
    )
    (tmp_path / "a.raw").write_text(text)
    (tmp_path / "b.raw").write_text(framed("oss3", "obdfilter.z.job_stats", TIME_2, POLL_1 * 3))
    (tmp_path / "c.raw").write_text("")
    assert len(check(rows, cut, spark, str(tmp_path), [60, 333, 10_000])) > 30


def test_blocks_that_are_cut_off(spark, rows, cut, tmp_path):
    """Without an end line a block is left out, also if it is cut off splits after its head; so is text after an end line."""
    whole, late = framed("oss1", "obdfilter.x.job_stats", TIME_1, POLL_1 * 4), framed("oss2", "obdfilter.y.job_stats", TIME_2, POLL_2 * 3)
    broken = framed("oss9", "obdfilter.q.job_stats", TIME_1, POLL_1 * 6).replace("### END ###", "")
    stray = "- job_id: stray\n  open: { samples: 9 }\n### END ###\n"
    texts = [whole + broken + late, broken + whole, whole + late + broken, broken * 3, late + stray + whole, stray + whole, POLL_1 + late]
    for n, text in enumerate(texts):
        path = tmp_path / f"{n}.raw"
        path.write_text(text)
        check(rows, cut, spark, str(path), [90, 100_000])


def test_random_logs(spark, rows, cut, tmp_path):
    rng = random.Random(11)
    for n in range(3):
        text = ""
        for k in range(12):
            jobs = "".join(f"- job_id: j{rng.randrange(50)}\n  snapshot_time: {rng.randrange(99)}\n" + "".join(f"  {op}: {{ samples: {rng.randrange(99)} }}\n" for op in rng.sample(["open", "read", "read", "write"], rng.randrange(4))) for _ in range(rng.choice([0, 1, 2, 60])))
            block = framed(f"h{k}", f"mdt.{k}.job_stats", f"2024-01-01T00:{k:02}:00Z", "job_stats:\n" + jobs)
            text += block if rng.random() < 0.8 else block.replace("### END ###\n", "")
        (tmp_path / f"{n}.raw").write_text(text)
    check(rows, cut, spark, str(tmp_path), [200, 5000])


def test_a_dump_of_many_tasks(spark, rows, cut, tmp_path):
    """One block of 200,000 jobs is parsed by many tasks, none of which sees much of it."""
    job = "concat('- job_id:          exe.', id, '.n1\n  snapshot_time:   ', 1700000000 + id % 7, '\n  open:            { samples: ', id % 100 + 1, ', unit: reqs }\n')"
    jobs = spark.range(0, 200_000, 1, 1).selectExpr(f"{job} AS value").toPandas()["value"]
    path = tmp_path / "big.raw"
    path.write_text(framed("oss1", "obdfilter.x.job_stats", TIME_1, "job_stats:\n" + "".join(jobs)))
    session = cut(1_000_000)
    parsed = parse_job_stats(read_large_logs(session, str(path)))
    found = parsed.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("samples").alias("total"), F.count_distinct("poll_ts", "host", "param").alias("blocks")).collect()
    assert len(found) > 15 and max(r["n"] for r in found) < 20_000
    assert sum(r["n"] for r in found) == 200_000 and sum(r["total"] for r in found) == 200_000 * 101 // 2 and {r["blocks"] for r in found} == {1}
    assert poll_register(read_large_logs(session, str(path))).count() == 1
