"""Parsing counter dumps: text blocks to one row per job and metric.

A block is cut at its job headers and exploded at once, so a long dump becomes
many short rows before anything else is done to it. All steps are built-in
expressions; no rows move between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtally.functions.arithmetic import any_of

# Keys of the dump text.
JOB_START = r"(?:^|\n)\s*- job_id:"
FLAT_JOB_START = r"(?:^|\n)\s*job_id:"
TIME_KEYS = ("snapshot_time", "start_time", "elapsed_time")
NUMBER_KEYS = ("samples", "min", "max", "sum")
HIST_START = "hist:{"

BLANKS = " \t\r\n\f\x0b"


def _whole(text: Column) -> Column:
    """Text of digits as BIGINT, 0 if there is none."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _jobs(blocks: DataFrame, pattern: str, explode=F.explode) -> DataFrame:
    """The text of each job as ``_job``: whatever follows a job header, up to the next."""
    rest = [name for name in blocks.columns if name != "data"]
    # A column of its own is cut once; inside the generator each mention would cut the block again.
    parts = blocks.select(*rest, F.split("data", pattern).alias("_parts"))
    return parts.select(*rest, explode(F.slice("_parts", 2, F.size("_parts"))).alias("_job"))


def _time(text: Column, key: str) -> Column:
    """The last valid ``key:  seconds[.fraction]`` line."""
    return _whole(F.regexp_extract(text, rf"(?s)^.*\n\s*{key}:*\s+([+-]?\d+)(?:\.\S*)?(?:\s|$)", 1))


def _timed_part(job: Column) -> Column:
    """The lines of a job that may hold its times: those before the first metric,
    or all of them if a time comes later."""
    head = F.substring_index(job, "{", 1)
    return F.when(F.substr(job, F.length(head) + 1).contains("_time:"), job).otherwise(head)


def _last_metrics(bares: Column) -> Column:
    """Metrics as ``_bare`` leaves them, the last one of each name."""
    keyed = F.transform(bares, lambda bare: F.struct(bare.alias("bare"), _name(bare).alias("name")))
    return keep_last(keyed, "name")["bare"]


def keep_last(entries: Column, key: str) -> Column:
    """Entries of an array of structs, the last one of each key."""
    backwards = F.reverse(entries[key])
    is_last = lambda entry, at: F.array_position(backwards, entry[key]) == F.size(backwards) - at
    return F.filter(entries, is_last)


def _is_metric(line: Column) -> Column:
    return line.contains("{") & line.contains("}") & ~any_of([line.contains(f"{key}:") for key in TIME_KEYS])


def _bare(line: Column) -> Column:
    return F.replace(F.btrim(line, F.lit(BLANKS)), F.lit(" "), F.lit(""))


def _name(bare: Column) -> Column:
    return F.rtrim(F.substring_index(bare, "{", 1), F.lit(":"))


def _item(values: Column, key: str) -> Column:
    """The last ``key:item`` of a comma list that begins with a comma."""
    mark = f",{key}:"
    return F.when(values.contains(mark), F.substring_index(F.substring_index(values, mark, -1), ",", 1)).otherwise("")


def _pairs(text: Column) -> Column:
    """``4K:1,4M:2`` as (key, value); entries without a number are left out."""
    count = lambda item: F.substr(item, F.instr(item, F.lit(":")) + 1)
    pair = lambda item: F.struct(
        F.substring_index(item, ":", 1).alias("key"),
        F.when(item.contains(":"), count(item).try_cast("bigint")).alias("value"),
    )
    return F.when(text != "", F.filter(F.transform(F.split(text, ","), pair), lambda entry: entry["value"].isNotNull()))


def _histogram(pairs: Column) -> Column:
    """The pairs as a map, the last one of each key; without pairs an empty one."""
    keys = pairs["key"]
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    full = F.map_from_entries(F.when(once, pairs).otherwise(keep_last(pairs, "key")))
    return F.when(pairs.isNull(), F.create_map().cast("map<string,bigint>")).otherwise(full)


def parse_job_stats(blocks: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per job and metric of every block.

    A job without metrics has one row with a null operation, which keeps its
    times. Blocks without jobs have no row, unless ``keep_empty`` asks for one
    with a null job to show that the poll took place.
    """
    rest = [name for name in blocks.columns if name != "data"]
    jobs = _jobs(blocks, JOB_START, F.explode_outer if keep_empty else F.explode)
    job = [*rest, "job_id", *TIME_KEYS]
    # Each step is a column that the next ones use, so that nothing is worked out twice.
    cut = jobs.select(
        *rest,
        F.btrim(F.substring_index("_job", "\n", 1), F.lit(BLANKS)).alias("job_id"),
        _timed_part(F.col("_job")).alias("_timed"),
        F.split("_job", "\n").alias("_lines"),
    ).select(
        *rest,
        "job_id",
        *[_time(F.col("_timed"), key).alias(key) for key in TIME_KEYS],
        F.transform(F.filter(F.slice("_lines", 2, F.size("_lines")), _is_metric), _bare).alias("_bares"),
    )
    named = cut.select(*job, "_bares", F.transform("_bares", _name).alias("_keys"))
    # Metrics hardly ever repeat within a job; they are only compared where one does.
    once = F.size(F.array_distinct("_keys")) == F.size("_keys")
    kept = named.select(*job, F.when(once, F.col("_bares")).otherwise(_last_metrics(F.col("_bares"))).alias("_kept"))
    # A job that has no metric is left with a null.
    return _columns(kept.select(*job, F.explode_outer("_kept").alias("_bare")), job)


def _columns(bare: DataFrame, job: list[str]) -> DataFrame:
    values = F.rtrim(F.substr(F.col("_bare"), F.instr("_bare", F.lit("{")) + 1), F.lit("}"))
    hist_at = F.instr("_values", F.lit(HIST_START))
    plain = (
        F.when(~F.col("_values").contains("hist:"), F.col("_values"))
        .when(hist_at > 0, F.substring_index("_values", HIST_START, 1))
        .otherwise("")
    )
    hist = F.when(
        hist_at > 0, F.substring_index(F.substr("_values", hist_at + len(HIST_START)), "}", 1)
    ).otherwise("")
    items = F.col("_items")
    return (
        bare.select(*job, _name(F.col("_bare")).alias("operation"), values.alias("_values"))
        .select(*job, "operation", F.concat(F.lit(","), plain).alias("_items"), hist.alias("_hist"))
        .select(
            *job,
            "operation",
            _whole(_item(items, "samples")).alias("samples"),
            _item(items, "unit").alias("unit"),
            *[_whole(_item(items, key)).alias(key) for key in NUMBER_KEYS[1:]],
            _pairs(F.col("_hist")).alias("_pairs"),
        )
        .withColumn("hist", _histogram(F.col("_pairs")))
        .drop("_pairs")
    )


def parse_histogram(samples: DataFrame) -> DataFrame:
    """One row per histogram bucket of a metric."""
    rest = [name for name in samples.columns if name != "hist"]
    # For a plain explode the planner filters by size first, and works out each histogram again for that.
    return samples.select(*rest, F.explode_outer("hist").alias("bucket", "count")).where("bucket IS NOT NULL")


def parse_flat_blocks(blocks: DataFrame) -> DataFrame:
    """Points of the flat dialect: ``job_id: x`` and then ``op: N`` or
    ``op: { samples: N ... }`` lines, timed by the block."""
    lines = F.split("_job", "\n")
    jobs = _jobs(blocks.select("poll_ts", "data"), FLAT_JOB_START)
    parts = jobs.select(
        F.col("poll_ts").alias("timestamp"),
        F.btrim(F.substring_index("_job", "\n", 1), F.lit(BLANKS)).alias("job_id"),
        F.explode(F.slice(lines, 2, F.size(lines))).alias("_line"),
    ).where(F.col("_line").contains(":"))
    cut = F.instr("_line", F.lit(":"))
    name = F.btrim(F.substr("_line", F.lit(1), cut - 1), F.lit(BLANKS))
    value = F.btrim(F.substr("_line", cut + 1), F.lit(BLANKS))
    number = F.when(
        F.col("_value").startswith("{"), F.regexp_extract("_value", r"samples:\s*(\d+)", 1)
    ).otherwise(F.regexp_extract("_value", r"^([+-]?\d+)$", 1))
    return (
        parts.select("timestamp", "job_id", name.alias("operation"), value.alias("_value"))
        .withColumn("value", number.try_cast("bigint"))
        .where(
            (F.col("operation") != "")
            & ~F.col("operation").contains(" ")
            & ~F.col("operation").isin(*TIME_KEYS)
            & F.col("value").isNotNull()
        )
        .drop("_value")
    )
