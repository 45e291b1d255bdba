"""Readers and writers: every format written is read back the same."""

import json

import pytest

from jobtally.operators import peaks
from jobtally.sinks import peaks as peak_sinks
from jobtally.sinks import points as sinks
from jobtally.sources import peaks as peak_sources
from jobtally.sources.points import detect_format, load_points, read_points_parquet, read_prometheus, read_victoriametrics
from jobtally.sources.raw_log import read_raw_log

T0 = 1704067200
COLUMNS = ["timestamp", "job_id", "operation", "value"]
POINTS = "timestamp BIGINT, job_id STRING, operation STRING, value BIGINT"


@pytest.fixture
def points(spark):
    ids = ['"dd.0.n1"', "back\\slash", "plain", "a b,c}", "umläut"]
    data = [(T0 + 10 * t + 86400 * (t % 2), job, op, t * 100 + i) for t in range(40) for i, job in enumerate(ids) for op in ("open", "ops")]
    return spark.createDataFrame(data, POINTS)


ENDINGS = {"parquet": "out.parquet", "prometheus": "out.prom", "victoriametrics": "out.vm.json"}


@pytest.mark.parametrize("fmt", list(ENDINGS))
@pytest.mark.parametrize("max_size", [None, "2k"])
def test_round_trip(spark, rows, points, tmp_path, fmt, max_size):
    path = str(tmp_path / ENDINGS[fmt])
    sinks.WRITERS[fmt](points, path, max_size=max_size)
    assert rows(load_points(spark, path), *COLUMNS) == rows(points, *COLUMNS)
    assert rows(load_points(spark, path, fmt), *COLUMNS) == rows(points, *COLUMNS)


def test_series_lines(spark, rows, points, tmp_path):
    path = str(tmp_path / "x-victoriametrics.json")
    sinks.write_victoriametrics(points, path, per_series=True)
    assert spark.read.text(path).count() == 5 * 2 * 2  # jobs, operations, days
    assert rows(load_points(spark, path), *COLUMNS) == rows(points, *COLUMNS)


def test_files_are_bounded_and_each_has_a_header(spark, points, tmp_path):
    path = tmp_path / "out.prom"
    sinks.write_prometheus(points.coalesce(1), str(path), max_size="4k")
    files = sorted(path.glob("part-*.txt"))
    assert len(files) > 3
    for file in files:
        lines = file.read_text().splitlines()
        assert lines[0] == "# HELP lustre_job_op_total Total operations per job and operation type"
        assert lines[1] == "# TYPE lustre_job_op_total counter"
        assert not any(line.startswith("#") for line in lines[2:])
        assert file.stat().st_size < 5000


def test_files_are_within_a_line_of_their_bound(spark, tmp_path):
    """Lines of very different lengths, one longer than the bound, from an input that is read once."""
    lengths = [10, 900, 3, 1, 250, 400, 5000, 0, 70, 999, 1, 1, 640] * 40
    lines = ["é" * (n // 2) + "x" * (n % 2) for n in lengths]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(list(enumerate(lines)), "n long, value string").coalesce(1).sortWithinPartitions("n").select("value")
    path = tmp_path / "bounded"
    sinks._text(frame.mapInArrow(counted, "value string"), str(path), "append", "1k", "head\n")
    files = [file.read_bytes() for file in sorted(path.glob("part-*.txt"))]
    texts = [file.decode().split("\n") for file in files]
    assert all(text[0] == "head" and text[-1] == "" for text in texts)
    assert [line for text in texts for line in text[1:-1]] == lines and read.value == len(lines)
    for file, after in zip(files, texts[1:]):
        assert len(file) <= 1024 or file.count(b"\n") == 2
        assert len(file) + len(after[1].encode()) + 1 > 1024


def test_exported_lines(spark):
    one = spark.createDataFrame([(T0, 'a"b', "read", 7)], POINTS)
    assert sinks.victoriametrics_lines(one).first()[0] == json.dumps(
        {"metric": {"__name__": "lustre_job_op", "job_id": 'a"b', "operation": "read"}, "values": [7], "timestamps": [T0 * 1000]},
        separators=(",", ":"),
    )
    from jobtally.functions.formats import prometheus_line

    assert one.select(prometheus_line()).first()[0] == f'lustre_job_op_total{{job_id="a\\"b",operation="read"}} 7 {T0 * 1000}'


def test_odd_prometheus_lines(spark, rows, tmp_path):
    path = tmp_path / "x.prom"
    path.write_text(
        "# a comment lustre_job_op_total{}\n\n"
        'lustre_job_op_total{job_id="77.geo",operation="read"} 805 1704067200412\n'
        'lustre_job_op_total{job_id="x",operation="read"} -5 1704067200000\n'
        'lustre_job_op_total{job_id="x",operation="read"} 5\n'
        'other_metric{job_id="x",operation="read"} 5 1704067200000\n'
        'lustre_job_op_total{job_id="\\\\n\\"q",operation="op"} 99999999999999999999 1704067200000\n'
    )
    assert rows(read_prometheus(spark, str(path)), *COLUMNS) == [(T0, "77.geo", "read", 805), (T0, '\\n"q', "op", 0)]


def test_odd_json_lines(spark, rows, tmp_path):
    path = tmp_path / "x.vm.json"
    lines = [
        {"metric": {"job_id": "a", "operation": "read"}, "values": [1, 2, 3], "timestamps": [T0 * 1000, T0 * 1000 + 5999]},
        {"metric": {"other": "x"}, "values": [4], "timestamps": [T0 * 1000]},
        {"metric": {"job_id": "b"}, "values": [4]},
        {"metric": {"job_id": "b"}, "values": ["x"], "timestamps": [1]},
        {"metric": {"job_id": "b"}, "values": [None], "timestamps": [1]},
        {"metric": {"job_id": "b"}, "values": [1.5], "timestamps": [1]},
        {"values": [1], "timestamps": [1]},
        {"metric": {"job_id": "b"}, "values": [], "timestamps": []},
    ]
    path.write_text("\n".join(json.dumps(line) for line in lines) + "\n\nnot json\n[]\n")
    assert rows(read_victoriametrics(spark, str(path)), *COLUMNS) == [
        (0, "a", "read", 3), (T0, "", "", 4), (T0, "a", "read", 1), (T0 + 5, "a", "read", 2),
    ]


def test_parquet_with_or_without_a_zone(spark, rows, tmp_path):
    made = {"ntz": "timestamp_ntz '2024-01-01 00:00:07.5'", "tz": "timestamp_seconds(1704067207)"}
    for name, when in made.items():
        path = str(tmp_path / f"{name}.parquet")
        spark.sql(f"SELECT {when} AS timestamp, j AS job_id, 'open' AS operation, 3L AS value FROM VALUES ('a'), (NULL) t(j)").write.parquet(path)
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        try:
            assert rows(read_points_parquet(spark, path), *COLUMNS) == [(T0 + 7, "a", "open", 3)]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sql("SELECT 1L AS timestamp, 'a' AS job_id, 'x' AS operation, 3L AS value").write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(ValueError):
        read_points_parquet(spark, str(tmp_path / "bad.parquet"))
    spark.sql("SELECT 1L AS other").write.parquet(str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        read_points_parquet(spark, str(tmp_path / "none.parquet"))


def test_times_are_stored_in_millis_and_bounds_reach_the_files(spark, rows, points, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "out.parquet"
    sinks.write_points_parquet(points, str(path))
    file = next(path.glob("date=2024-01-02/*.parquet"))
    assert str(pq.ParquetFile(file).schema_arrow.field("timestamp").type) == "timestamp[ms, tz=UTC]"
    low, high = T0 + 86400 + 50, T0 + 86400 + 200
    found = load_points(spark, str(path), start=low, end=high)
    assert rows(found, *COLUMNS) == rows(points.where(f"timestamp BETWEEN {low} AND {high}"), *COLUMNS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(timestamp,2024-01-02" in plan
    text = str(tmp_path / "out.prom")
    sinks.write_prometheus(points, text)
    assert rows(load_points(spark, text, start=low, end=high), *COLUMNS) == rows(found, *COLUMNS)


def test_formats_by_name():
    names = {
        "a.parquet": "parquet", "d/b.raw.log": "raw", "b.raw": "raw", "x-raw.txt": "raw", "c.prom": "prometheus",
        "c.prometheus": "prometheus", "e.vm.json": "victoriametrics", "e.victoriametrics": "victoriametrics",
        "x-victoriametrics.json": "victoriametrics", "folder.prom/": "prometheus", "folder.parquet/*": "parquet",
    }
    assert {name: detect_format(name) for name in names} == names
    with pytest.raises(ValueError):
        detect_format("notes.txt")


def test_the_job_marker_is_no_counter(spark, rows, tmp_path):
    path = tmp_path / "x.prom"
    path.write_text('lustre_job_op_total{job_id="a",operation="job_id"} 0 1704067200000\n')
    assert load_points(spark, str(path)).count() == 0


def test_raw_round_trip(spark, rows, golden_log, tmp_path):
    blocks = read_raw_log(spark, golden_log)
    sinks.write_raw_log(blocks, str(tmp_path / "copy.raw"), max_size="1k")
    assert rows(read_raw_log(spark, str(tmp_path / "copy.raw"))) == rows(blocks)
    assert load_points(spark, golden_log).where("job_id = 'dd.0.n1' AND operation = 'write'").count() == 2


def test_one_failing_sink_stops_no_other(spark, points, tmp_path):
    def broken(df):
        raise OSError("disk is gone")

    good = str(tmp_path / "good.parquet")
    failed = sinks.fan_out(points, {"bad": broken, "good": lambda df: sinks.write_points_parquet(df, good)})
    assert list(failed) == ["bad"]
    assert load_points(spark, good).count() == points.count()


TOTALS = "poll_ts BIGINT, operation STRING, value BIGINT"
TABLE = "poll_ts BIGINT, job_id STRING, ops BIGINT, open BIGINT, write BIGINT"


def test_peaks_are_the_earliest_best(spark, rows):
    totals = spark.createDataFrame([(5, "open", 3), (2, "open", 9), (7, "open", 9), (4, "sync", 0), (6, "sync", 0)], TOTALS)
    assert rows(peaks.peak_ops(totals)) == [("open", 9, 2), ("sync", 0, 4)]
    table = spark.createDataFrame([(5, "b", 9, 0, 9), (5, "a", 9, 0, 9), (7, "c", 12, 0, None), (3, "z", 9, 0, 8)], TABLE)
    assert rows(peaks.peak_jobs(table)) == [
        ("ops", "c", 12, {"ops": 12, "open": 0}, 7), ("write", "a", 9, {"ops": 9, "open": 0, "write": 9}, 5),
    ]


def test_stored_peaks(spark, rows, tmp_path):
    path = str(tmp_path / "peaks")
    ops, jobs = peak_sources.load_peaks(spark, path)
    assert ops.count() == 0 and jobs.count() == 0
    first = spark.createDataFrame([(5, "a", 9, 4, 5)], TABLE)
    later = spark.createDataFrame([(8, "b", 9, 6, 3)], TABLE)
    for table in (first, later, later):  # the second batch is run twice
        totals = table.selectExpr("poll_ts", "stack(2, 'ops', ops, 'open', open) AS (operation, value)")
        peak_sinks.write_peaks(peaks.peak_ops(totals), peaks.peak_jobs(table), path)
    ops, jobs = peak_sources.load_peaks(spark, path)
    assert rows(ops) == [("open", 6, 8), ("ops", 9, 5)]
    assert rows(jobs, "operation", "job_id", "rate", "timestamp") == [("open", "b", 6, 8), ("ops", "a", 9, 5), ("write", "a", 5, 5)]
    assert rows(jobs.where("operation = 'open'"), "ops") == [({"ops": 9, "open": 6, "write": 3},)]
    db = str(tmp_path / "db.json")
    peak_sinks.write_peaks_json(ops, jobs, db)
    again_ops, again_jobs = peak_sources.read_peaks_json(spark, db)
    for _ in range(2):  # the database is updated in place
        peak_sinks.write_peaks_json(again_ops, again_jobs, db)
        again_ops, again_jobs = peak_sources.read_peaks_json(spark, db)
    assert rows(again_ops, "operation", "rate", "timestamp") == rows(ops, "operation", "rate", "timestamp")
    columns = ["operation", "job_id", "rate", "ops", "timestamp"]
    assert rows(again_jobs, *columns) == rows(jobs, *columns)


def test_a_pretty_printed_peak_database(spark, rows, tmp_path):
    db = {
        "top_ops": {"open": {"rate": 4, "timestamp": 9}},
        "top_job_per_op": {
            "open": {"job_id": "a", "ops": {"open": 4, "job_id": 0}, "timestamp": 9},
            "sync": {"job_id": "", "ops": {}, "timestamp": 9},
        },
    }
    path = tmp_path / "db.json"
    path.write_text(json.dumps(db, indent=2))
    ops, jobs = peak_sources.read_peaks_json(spark, str(path))
    assert rows(ops) == [("open", 4, 9)]
    assert rows(jobs, "operation", "job_id", "rate") == [("open", "a", 4)]
