"""Whole-number arithmetic shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(dividend: Column, divisor: Column) -> Column:
    """Integer quotient. The divisor is held at 1 or more so that a predicate
    moved past a guard by the optimizer can never divide by zero."""
    return F.call_function("div", dividend, F.greatest(divisor, F.lit(1).cast("bigint")))


def change_per(old: str, new: str, seconds: str | None) -> str:
    """SQL for the growth of a counter, 0 after a reset; per second if asked.

    Null where the counter was never seen before; a counter gone since is 0.
    """
    grown = f"greatest(coalesce({new}, 0L) - {old}, 0L)"
    value = grown if seconds is None else f"{grown} div greatest({seconds}, 1L)"
    return f"CASE WHEN {old} IS NOT NULL THEN {value} END"


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))
