"""How values are shown: short counts, times, axis steps, cut and padded ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the report clock and of the report label width.
REPORT_CLOCK = "EEE dd MMM yyyy HH-mm-ss Z"
LABEL_WIDTH = 17
TRAILING_SECONDS = 300


def human_count(value: Column) -> Column:
    """1234567 as 1.2M, 1234 as 1.2K, smaller numbers as they are."""
    scaled = lambda unit, mark: F.concat(
        F.call_function("format_number", value / F.lit(float(unit)), F.lit("0.0")), F.lit(mark)
    )
    return (
        F.when(value >= 1000000, scaled(1000000, "M"))
        .when(value >= 1000, scaled(1000, "K"))
        .otherwise(value.cast("string"))
    )


def log_height(value: Column) -> Column:
    """Bar height on a log scale: whole thousandths of log10(value + 1)."""
    height = F.floor(F.log10(value + F.lit(1.0)) * 1000).cast("bigint")
    return F.when(value > 0, height).otherwise(F.lit(0).cast("bigint"))


def nice_ceiling(value: Column) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten, and a tenth above it."""
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    lead = value / magnitude
    step = F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0)
    return F.when(value <= 0, F.lit(100.0)).otherwise(step * magnitude * 1.1)


def truncate_id(job_id: Column, width: int) -> Column:
    """Ids longer than ``width`` end in three dots."""
    return F.when(F.length(job_id) > width, F.concat(F.left(job_id, F.lit(width - 3)), F.lit("..."))).otherwise(job_id)


def pad_label(label: Column, width: int = LABEL_WIDTH) -> Column:
    """Fill up to ``width``; longer labels are left whole."""
    return F.when(F.length(label) < width, F.rpad(label, width, " ")).otherwise(label)


def report_time(seconds: Column, human: bool = False) -> Column:
    """Epoch seconds, or the report clock in the session time zone."""
    return F.date_format(F.timestamp_seconds(seconds), REPORT_CLOCK) if human else seconds.cast("string")


def utc_time(seconds: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC, whatever the session time zone."""
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span).cast("string")


def utc_clock(seconds: Column) -> Column:
    """HH:mm:ss in UTC."""
    return F.substring(utc_time(seconds), 12, 8)


def progress(at: Column, start: Column, end: Column) -> Column:
    """Position within a range as a fraction between 0 and 1; 0 if it is empty."""
    share = (at - start) / F.greatest(end - start, F.lit(1))
    return F.when(end == start, F.lit(0.0)).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def trailing_window(at: Column, start: Column, seconds: int = TRAILING_SECONDS) -> tuple[Column, Column]:
    """Bounds of the window that ends at a time and does not precede ``start``."""
    return F.greatest(at - seconds, start), at
