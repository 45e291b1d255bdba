"""The per-poll report: options, result tables and its lines of text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtally.functions import display
from jobtally.functions.layout import JobIdLayout
from jobtally.functions.vocabulary import BYTE_OPERATIONS, SHORT_BY_LONG, TOTAL, check_operation, short_name
from jobtally.operators import merge, peaks, rates, shares, topn
from jobtally.session import written

# The wording of the report.
COUNTER_LABEL = "top_{}_jobs:"
RATE_LABEL = "top_{}_job_operation_rates_during_query_windows:"
DIFF_LABEL = "top_{}_job_operation_difference_between_query_windows:"
PERCENT_LABEL = "top_{}_job_operations_in_percent_to_total_operations:"
RATE_TOTAL_LABEL = "total_rate_per_operation_during_query_window:"
TOTAL_LABEL = "total_operations:"
PEAK_OPS_LABEL = "highest_rate_per_operation_in_logfile:"
PEAK_JOBS_LABEL = "job_with_hightest_rate_per_operation_in_logfile:"
DOCUMENT_START = "---"
DOCUMENT_END = "..."
OPERATION_WIDTH = 10


@dataclass(frozen=True)
class Options:
    """What a report shows; the defaults are those of a plain top-5 list."""

    count: int = 5
    groupby: str = "none"
    sortby: str = TOTAL
    mode: str = "counter"  # counter, rate or diff
    percent: bool = False
    total: bool = False
    peaks: bool = False
    min_rate: int = 1
    patterns: tuple[str, ...] = ()
    invert: bool = False
    include_bytes: bool = False
    fullname: bool = False
    human_time: bool = False
    width: int = display.LABEL_WIDTH

    def __post_init__(self) -> None:
        if self.mode not in ("counter", "rate", "diff"):
            raise ValueError(f"mode must be counter, rate or diff, not {self.mode!r}")
        check_operation(self.sortby)
        if self.peaks:  # peaks are kept of rates, and shown with their totals
            self._set(mode="rate", total=True, percent=False)
        if self.percent:
            self._set(total=True)

    def _set(self, **values) -> None:
        for name, value in values.items():
            object.__setattr__(self, name, value)

    @property
    def label(self) -> str:
        if self.percent:
            return PERCENT_LABEL.format(self.count)
        return {"rate": RATE_LABEL, "diff": DIFF_LABEL, "counter": COUNTER_LABEL}[self.mode].format(self.count)


@dataclass(frozen=True)
class Result:
    """The tables of a report; totals and peaks are None unless asked for.

    ``peak_ops`` and ``peak_jobs`` are those of all polls, the running ones as they stood after each poll of the report.
    """

    summary: DataFrame
    top: DataFrame
    totals: DataFrame | None
    peak_ops: DataFrame | None
    peak_jobs: DataFrame | None
    running_ops: DataFrame | None = None
    running_jobs: DataFrame | None = None


def build(samples: DataFrame, polls: DataFrame, options: Options, layout: JobIdLayout | None = None) -> Result:
    """Counters to summary, top list, totals and peaks of every poll.

    Totals cover all jobs; filters and the minimum rate apply to the list only.
    The summary, and the table all else is made from, are computed now and kept
    in the shared folder.
    """
    table = merge.job_table(samples, layout, options.groupby, options.include_bytes)
    summary = merge.poll_summary(merge.rekey(samples, layout, options.groupby), polls)
    if options.mode != "counter":
        table = rates.job_rates(table, options.mode)
        summary = summary.where("query_duration > 0")
    summary, table = written(summary, "summary"), written(table, "report")
    listed = shares.percent_table(table) if options.percent else table
    top = topn.top_jobs(
        listed, options.sortby, options.count, options.min_rate, options.patterns, options.invert
    )
    totals = shares.totals(table) if options.total else None
    return Result(
        summary,
        top,
        totals,
        peaks.peak_ops(totals) if options.peaks else None,
        peaks.peak_jobs(table) if options.peaks else None,
        _shown(peaks.running_peak_ops(totals, polls=polls), summary) if options.peaks else None,
        _shown(peaks.running_peak_jobs(table, polls=polls, vectors=True), summary) if options.peaks else None,
    )


def _shown(running: DataFrame, summary: DataFrame) -> DataFrame:
    return running.join(summary.select("poll"), "poll", "left_semi")


def _numbers(names: list[str], fullname: bool) -> Column:
    """``op: n`` of every operation present, in vocabulary order, bytes left out."""
    cells = [
        f"struct('{name if fullname else SHORT_BY_LONG[name]}' AS k, {name} AS v)"
        for name in names
        if name not in BYTE_OPERATIONS
    ]
    return F.expr(
        f"""array_join(transform(filter(array({', '.join(cells)}), e -> e.v IS NOT NULL),
                                 e -> concat(e.k, ': ', e.v)), ', ')"""
    )


def _with_label(df: DataFrame, fullname: bool) -> DataFrame:
    """Add ``label``, the padded name of the operation of each row."""
    name = F.col("operation") if fullname else short_name(F.col("operation"))
    named = df.withColumn("_name", F.concat(name, F.lit(":")))
    return named.withColumn("label", display.pad_label(F.col("_name"), OPERATION_WIDTH))


def lines(result: Result, options: Options) -> DataFrame:
    """The report as rows (poll, part, pos, line), to be ordered by these."""
    known = merge.operation_columns(result.top)
    filled = result.top.groupBy("poll").agg(F.count("*").alias("_shown"))
    facts = [F.lit(DOCUMENT_START), F.concat(F.lit("timestamp: "), display.report_time(F.col("poll_ts"), options.human_time))]
    if options.mode != "counter":
        facts.append(F.concat(F.lit("query_duration: "), "query_duration"))
    counts = {"servers_queried": "servers", "osts_queried": "osts", "mdts_queried": "mdts", "total_jobs": "total_jobs"}
    facts += [F.concat(F.lit(f"{name}: "), column) for name, column in counts.items()]
    facts.append(F.when(F.col("_shown").isNull(), options.label + " []").otherwise(options.label))
    header = result.summary.join(filled, "poll", "left").select(
        "poll", F.lit(0).alias("part"), F.posexplode(F.array(*facts)).alias("pos", "line")
    )
    window = F.expr(f"concat(', {'sampling_window' if options.fullname else 'sw'}: ', sampling_window)") if (
        "sampling_window" in result.top.columns
    ) else F.lit("")
    job = F.concat(
        F.lit("- "), display.pad_label(F.concat("job_id", F.lit(":")), options.width), F.lit(" {"),
        _numbers(known, options.fullname), window, F.lit("}"),
    )
    parts = [header, result.top.select("poll", F.lit(1).alias("part"), F.col("rank").alias("pos"), job.alias("line"))]
    ending = result.summary.select("poll", F.lit(9).alias("part"), F.lit(0).alias("pos"), F.lit(DOCUMENT_END).alias("line"))
    if result.totals is not None:
        title = RATE_TOTAL_LABEL if options.mode == "rate" else TOTAL_LABEL
        parts.append(
            result.summary.select("poll", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit(title).alias("line"))
        )
        by_value = Window.partitionBy("poll").orderBy(F.desc("value"), "operation")
        total = F.concat(F.lit("- "), "label", F.lit(" {rate: "), "value", F.lit("}"))
        parts.append(
            _with_label(result.totals.withColumn("pos", F.row_number().over(by_value)), options.fullname).select(
                "poll", F.lit(2).alias("part"), "pos", total.alias("line")
            )
        )
    if result.running_ops is not None:
        titles = F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(0).alias("pos"), F.lit(title).alias("line")) for part, title in PEAK_TITLES]))
        parts.append(result.summary.select("poll", titles))
        parts += _peak_rows(result.running_ops, result.running_jobs, options, ["poll"])
    return reduce(DataFrame.unionByName, [*parts, ending])


PEAK_TITLES = ((3, PEAK_OPS_LABEL), (4, PEAK_JOBS_LABEL))


def peak_lines(ops: DataFrame, jobs: DataFrame, options: Options) -> DataFrame:
    """Stored peaks as rows (part, pos, line); 28 operations at most."""
    titles = [(part, 0, title) for part, title in (*PEAK_TITLES, (5, DOCUMENT_END))]
    start = ops.sparkSession.createDataFrame(titles, "part INT, pos INT, line STRING")
    return reduce(DataFrame.unionByName, _peak_rows(ops, jobs, options, []), start)


def _peak_rows(ops: DataFrame, jobs: DataFrame, options: Options, by: list[str]) -> list[DataFrame]:
    """Peaks of operations and of jobs as rows (by..., part, pos, line)."""
    at = display.report_time(F.col("timestamp"), options.human_time)
    clock = "timestamp" if options.fullname else "ts"
    by_rate = (Window.partitionBy(*by) if by else Window).orderBy(F.desc("rate"), "operation")
    best = F.concat(
        F.lit("- "), "label", F.lit(" {rate: "),
        display.pad_label(F.concat("rate", F.lit(",")), OPERATION_WIDTH), F.lit(f" {clock}: "), at, F.lit("}"),
    )
    name = (lambda key: key) if options.fullname else short_name
    largest_first = F.array_sort(
        F.transform(F.map_entries("ops"), lambda e: F.struct((-e["value"]).alias("loss"), e["key"].alias("key")))
    )
    numbers = F.array_join(
        F.transform(largest_first, lambda e: F.concat(name(e["key"]), F.lit(": "), -e["loss"])), ", "
    )
    holder = F.concat(
        F.lit("- "), "label", F.lit(" {"), numbers,
        F.lit(f", {clock}: "), at, F.lit(", job_id: "), "job_id", F.lit("}"),
    )
    ranked = lambda df: _with_label(df.withColumn("pos", F.row_number().over(by_rate)), options.fullname)
    return [
        ranked(ops).select(*by, F.lit(3).alias("part"), "pos", best.alias("line")),
        ranked(jobs).select(*by, F.lit(4).alias("part"), "pos", holder.alias("line")),
    ]
