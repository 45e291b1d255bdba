"""Log stores that prune by folder, and the ledger of sinks."""

import re

import pytest
from conftest import POLL_1, POLL_2, framed

from jobtally.operators.merge import scope_sources
from jobtally.sinks.ledger import SinkLedger
from jobtally.sinks.points import SinksFailed, write_log_store
from jobtally.sources.raw_log import read_log_store, read_raw_log
from jobtally.streaming import feed

BLOCK = ["host", "param", "poll_ts", "data"]


@pytest.fixture
def store(spark, tmp_path):
    text = "".join(
        framed(host, f"{kind}.fs-{n}.job_stats", f"2024-01-0{day}T0{n}:00:00Z", POLL_1 if n else POLL_2)
        for day in (1, 2, 3) for host in ("oss1", "mds:1 a/b") for kind in ("obdfilter", "mdt", "osd") for n in range(2)
    )
    log = tmp_path / "a.raw"
    log.write_text(text)
    blocks = read_raw_log(spark, str(log))
    write_log_store(blocks, str(tmp_path / "store"))
    return blocks, str(tmp_path / "store")


D2 = 1704067200 + 86400


@pytest.mark.parametrize(
    "scope",
    [
        {}, {"servers": ["oss1"]}, {"servers": ["mds:1 a/b", "none"]}, {"ost": True}, {"mdt": True, "servers": ["oss1"]},
        {"param": "osd.*.job_stats"}, {"param": "o*.fs-1.*"}, {"param": "[mo]?t.fs-0.job_stats"}, {"start": D2}, {"end": D2},
        {"start": D2 + 1, "end": D2 + 86400 + 3600, "mdt": True}, {"servers": []},
    ],
)
def test_a_store_gives_what_filters_give(spark, rows, store, scope):
    blocks, path = store
    start, end = scope.get("start", 0), scope.get("end", 2**40)
    wanted = {name: value for name, value in scope.items() if name not in ("start", "end")}
    expected = scope_sources(blocks, **wanted).where(f"poll_ts BETWEEN {start} AND {end}")
    assert rows(read_log_store(spark, path, **scope), *BLOCK) == rows(expected, *BLOCK)


def test_scopes_are_partition_filters(spark, store):
    found = read_log_store(spark, store[1], ["oss1"], ost=True, start=D2, end=D2 + 3600)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    filters = re.search(r"PartitionFilters: \[(.*)\]", found._jdf.queryExecution().explainString(mode)).group(1)
    assert all(name in filters for name in ("kind#", "server#", "day#"))
    assert found.select("host").count() == 2
    assert found.selectExpr("input_file_name() AS f").distinct().count() == 1


def test_only_sinks_that_failed_run_again(spark, tmp_path):
    runs = {"good": 0, "bad": 0, "odd/name=": 0}

    def sink(name, fails):
        def write(df, batch_id):
            runs[name] += 1
            if runs[name] <= fails:
                raise OSError("no space")

        return write

    sinks = {"good": sink("good", 0), "bad": sink("bad", 2), "odd/name=": sink("odd/name=", 0)}
    write = feed.every_batch(sinks, ledger=str(tmp_path / "ledger"))
    df = spark.range(3)
    for _ in range(2):
        with pytest.raises(SinksFailed, match="no space"):
            write(df, 0)
    write(df, 0)
    write(df, 0)
    assert runs == {"good": 1, "bad": 3, "odd/name=": 1}
    for batch_id in range(1, 8):
        write(df, batch_id)
    ledger = SinkLedger(str(tmp_path / "ledger"))
    assert runs["good"] == 8 and ledger.done(spark, 0) == set() and len(ledger.done(spark, 7)) == 3
    ledger.forget(spark, 7)
    write(df, 7)
    assert runs["good"] == 9
