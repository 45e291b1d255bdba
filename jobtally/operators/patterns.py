"""Filters by tables of patterns, as many as there may be: an index of grams instead of a test of each pair.

An id can only contain a pattern if it has all of the pattern's grams, runs of three characters. Each pattern is filed
under the one of its grams that fewest ids have; ids meet it by an equi-join on their own grams and only those pairs are
compared as text. Patterns of one or two characters are filed under themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text: str, sizes: range) -> Column:
    """All different runs of the given sizes."""
    runs = [
        F.expr(f"transform(sequence(1, greatest(length({text}) - {n - 1}, 0), 1), i -> substr({text}, i, {n}))") for n in sizes
    ]
    some = [F.when(F.length(text) >= n, run).otherwise(F.array().cast("array<string>")) for n, run in zip(sizes, runs)]
    return F.array_distinct(F.concat(*some))


def _own_grams(text: str) -> Column:
    """The grams a pattern may be filed under."""
    return F.when(F.length(text) <= GRAM, F.array(text)).otherwise(_grams(text, range(GRAM, GRAM + 1)))


def matching_jobs(ids: DataFrame, patterns: DataFrame) -> DataFrame:
    """The different values of ``job_id`` that contain any ``pattern``.

    Nulls match nothing; an empty pattern would match everything and is an error.
    """
    once = ids.select("job_id").where(F.col("job_id").isNotNull()).distinct()
    checked = F.when(F.col("pattern") == "", F.raise_error(F.lit("an empty pattern would match every job"))).otherwise(F.col("pattern"))
    wanted = patterns.where(F.col("pattern").isNotNull()).select(checked.alias("pattern")).distinct()
    id_grams = once.select("job_id", F.explode(_grams("job_id", range(1, GRAM + 1))).alias("gram"))
    pattern_grams = wanted.select("pattern", F.explode(_own_grams("pattern")).alias("gram"))
    # A gram that no id has keeps its pattern out of the join below, as it should.
    held = id_grams.join(pattern_grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    known = pattern_grams.join(held, "gram", "left")
    filed = known.groupBy("pattern").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("least"))
    keys = filed.where("least.held > 0").select("pattern", F.col("least.gram").alias("gram"))
    return id_grams.join(keys, "gram").where(F.col("job_id").contains(F.col("pattern"))).select("job_id").distinct()


def filter_jobs_by(df: DataFrame, patterns: DataFrame, invert: bool = False) -> DataFrame:
    """``filters.filter_jobs`` for a table of patterns: drop jobs whose id contains any, or with ``invert`` keep only those.

    Rows without an id are dropped either way, as there.
    """
    matched = matching_jobs(df, patterns)
    if invert:
        return df.join(matched, "job_id", "left_semi")
    return df.where(F.col("job_id").isNotNull()).join(matched, "job_id", "left_anti")
