"""Joins and neighbour look-ups that stay even when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SECONDS = 86400


def salted_join(
    rows: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join ``rows`` to a side with one row per key, each key cut into ``salts``.

    ``spread`` is a column of ``rows`` that varies within a key; ``salts`` is by
    default the number of shuffle partitions, so that one key can use them all.
    The small side is repeated once per salt; it is broadcast only if the planner
    finds it under its own threshold, and shuffled on (key, salt) otherwise. Where
    both sides come from one aggregate, an inner join lets them read its shuffle
    once.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.expr(f"coalesce(cast(pmod(xxhash64({spread}), {salts}) AS INT), 0)")
    salted = rows.withColumn("_salt", salt)
    copies = small.withColumn("_salt", F.expr(f"explode(sequence(0, {salts - 1}))"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def beside(
    points: DataFrame, keys: list[str], forward: bool = False, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Attach ``beside``, the (timestamp, value) before or after each point of
    its series.

    A series is cut into chunks of time, so a window group holds one chunk, not
    a whole history. The point at the edge of a chunk comes from the nearest
    chunk that has points: one small row per series and chunk, taken from the
    same shuffle as the chunks themselves.
    """
    # A chunk that cannot be null keeps the planner from filtering one branch only,
    # so that both read the same shuffle.
    chunk = F.expr(f"coalesce(timestamp div {chunk_seconds}, 0L)")
    step = F.lead if forward else F.lag
    ends, end_value = (F.min, F.min_by) if forward else (F.max, F.max_by)
    chunked = (
        points.select(*keys, "timestamp", "value")
        .withColumn("_chunk", chunk)
        .repartition(*keys, "_chunk")
    )
    edges = chunked.groupBy(*keys, "_chunk").agg(
        ends("timestamp").alias("timestamp"), end_value("value", "timestamp").alias("value")
    )
    point = F.struct("timestamp", "value")
    by_series = Window.partitionBy(*keys).orderBy("_chunk")
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy("timestamp")
    carried = edges.select(*keys, "_chunk", step(point).over(by_series).alias("_carried"))
    return (
        chunked.withColumn("_beside", step(point).over(in_chunk))
        .join(carried, [*keys, "_chunk"])
        .select(*keys, "timestamp", "value", F.coalesce("_beside", "_carried").alias("beside"))
    )


def first_by(value: str, *order: str) -> Column:
    """The row of a group with the smallest ``order``, as struct (order..., value)."""
    return F.expr(f"min(struct({', '.join(order)}, {value}))")
