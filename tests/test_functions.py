"""Value objects and column expressions."""

import pytest
from pyspark.sql import functions as F

from jobtally.functions import display, formats, vocabulary
from jobtally.functions.layout import JobIdLayout
from jobtally.functions.sizes import parse_size
from jobtally.operators import filters


@pytest.mark.parametrize(
    "text, size",
    [("0", 0), ("77", 77), ("3k", 3072), ("7K", 7168), ("0.25M", 1 << 18), ("12m", 12 << 20), ("2g", 2 << 30), ("5T", 5 << 40),
     ("2P", 2 << 50), ("\t6k ", 6144)],
)
def test_sizes(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", ["", "abc", "1X", "-1k", "k"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        parse_size(text)


def test_layouts():
    assert JobIdLayout.parse("%e.%u.%H") == JobIdLayout(("exe", "user", "host_short"), ".")
    assert JobIdLayout.parse("%j:%h:%p:%g") == JobIdLayout(("job", "host", "proc", "group"), ":")
    assert JobIdLayout.parse("%u") == JobIdLayout(("user",), ".")
    with pytest.raises(ValueError):
        JobIdLayout.parse("%e.%u").position("host")


def values(spark, data, *columns):
    rows = [row if isinstance(row, tuple) else (row,) for row in data]
    kind = "BIGINT" if isinstance(rows[0][0], int) else "STRING"
    return [tuple(r) for r in spark.createDataFrame(rows, f"v {kind}").select(*columns).collect()]


def test_group_keys(spark):
    layout = JobIdLayout.parse("%e.%u.%H")
    ids = ["dd.0.n1", '"dd.0.n1"', "plain", "a.b", "a..c"]
    key = lambda name, **kw: [v for v, in values(spark, ids, layout.group_key(F.col("v"), name, **kw))]
    assert key("user") == ['"0"', '"0"', "plain", '"b"', '""']
    assert key("host_short") == ['"n1"', '"n1"', "plain", "a.b", '"c"']
    assert key("none") == ids
    assert key("exe", quote=False)[0] == "dd"
    pipes = JobIdLayout.parse("%e|%u")
    assert values(spark, ["x|y"], pipes.group_key(F.col("v"), "user")) == [('"y"',)]
    words = JobIdLayout.parse("%ez%u")
    assert values(spark, ["1z2"], *words.columns(F.col("v"))) == [("1", "2")]


def test_component_filter(spark, rows):
    jobs = spark.createDataFrame([("dd.10.n1",), ("cp.2.n1",), ("dd.1",), ("solo",)], "job_id STRING")
    layout = JobIdLayout.parse("%e.%u.%H")
    kept = lambda *a, **kw: rows(filters.filter_components(jobs, layout, *a, **kw))
    assert kept(components={"user": "1"}) == [("dd.1",), ("dd.10.n1",)]
    assert kept(components={"host_short": "n", "exe": "d"}) == [("dd.10.n1",)]
    assert kept("dd", {"user": ""}) == [("dd.1",), ("dd.10.n1",)]


def test_selections_from_a_table(spark, rows):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id STRING")
    ids = jobs.where("job_id <> 'c'")
    assert rows(filters.select_jobs(jobs, ids, "inclusive")) == [("a",), ("b",)]
    assert rows(filters.select_jobs(jobs, ids, "exclusive")) == [("c",)]
    assert rows(filters.select_jobs(jobs, ids)) == [("a",), ("b",), ("c",)]
    with pytest.raises(ValueError):
        filters.select_jobs(jobs, ids, "some")


def test_names(spark):
    v = F.col("v")
    assert values(spark, ["ops", "write_bytes", "mystery_op", "abc"], vocabulary.short_name(v)) == [("ops",), ("wb",), ("myst",), ("abc",)]
    assert values(spark, ["wb", "zz"], vocabulary.long_name(v)) == [("write_bytes",), ("zz",)]
    assert len(vocabulary.LONG_NAMES) == 28 and len(set(vocabulary.SHORT_BY_LONG.values())) == 28


def test_counts(spark):
    numbers = [-5, 0, 999, 1000, 1050, 1150, 1250, 999949, 1000000, 12345678]
    shown = [v for v, in values(spark, numbers, display.human_count(F.col("v")))]
    assert shown == ["-5", "0", "999", "1.0K", "1.1K", "1.1K", "1.2K", "999.9K", "1.0M", "12.3M"]


def test_axes(spark):
    v = F.col("v")
    assert values(spark, [-3, 0, 9, 99, 100], display.log_height(v)) == [(0,), (0,), (1000,), (2000,), (2004,)]
    nice = [round(x, 6) for x, in values(spark, [0, -1, 1, 2, 3, 7, 10, 1300, 5001], display.nice_ceiling(v))]
    assert nice == [100.0, 100.0, 1.1, 2.2, 5.5, 11.0, 11.0, 2200.0, 11000.0]


def test_ids(spark):
    v = F.col("v")
    assert values(spark, ["short", "much-too-long"], display.truncate_id(v, 8)) == [("short",), ("much-...",)]
    assert values(spark, ["ab", "abcdef"], display.pad_label(v, 4)) == [("ab  ",), ("abcdef",)]


def test_times(spark):
    v = F.col("v")
    at = 1704067205
    assert values(spark, [at], display.utc_time(v), display.utc_clock(v)) == [("2024-01-01 00:00:05", "00:00:05")]
    assert values(spark, [at], display.report_time(v), display.report_time(v, True)) == [
        (str(at), "Mon 01 Jan 2024 00-00-05 +0000")
    ]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert values(spark, [at], display.utc_time(v)) == [("2024-01-01 00:00:05",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_progress(spark):
    v = F.col("v")
    share = display.progress(v, F.lit(100), F.lit(200))
    assert values(spark, [50, 100, 150, 900], share) == [(0.0,), (0.0,), (0.5,), (1.0,)]
    assert values(spark, [50], display.progress(v, F.lit(7), F.lit(7))) == [(0.0,)]
    assert values(spark, [150, 900], *display.trailing_window(v, F.lit(100))) == [(100, 150), (600, 900)]


def test_labels(spark):
    v = F.col("v")
    odd = ['a"b', "back\\slash", "line\nend", "\\n", '\\"', "plain"]
    assert values(spark, odd, formats.unescape_label(formats.escape_label(v))) == [(x,) for x in odd]
    assert values(spark, ['a"\\\n'], formats.escape_label(v)) == [('a\\"\\\\\\n',)]


def test_labels_come_back_whole(spark):
    texts = ["plain", 'q"q', "b\\b", "n\nn", "\\n", "\\\\n", '\\"', "nul\0nul", "\\", ""]
    df = spark.createDataFrame([(t,) for t in texts], "v STRING")
    assert [r[0] for r in df.select(formats.unescape_label(formats.escape_label(F.col("v")))).collect()] == texts
