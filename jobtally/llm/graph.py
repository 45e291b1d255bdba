"""Connected components by large-star and small-star steps, cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtally.llm.tables import drop_table, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a")
    return moved.select("a", F.col("least").alias("b")).unionByName(moved.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) to (a, b): each linked node but the least of its component, and that least node.

    Hot nodes are safe: least neighbours are combined map-side and the joins are plain, so Spark splits skewed keys.
    """
    spark = edges.sparkSession
    schema = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).schema

    def load(path):
        return spark.read.schema(schema).parquet(path)

    path = write_table(edges.where("a <> b").distinct(), "links")
    before = _mark(load(path))
    while before[0]:
        after_path = write_table(_small_star(_large_star(load(path))), "links")
        after = _mark(load(after_path))
        drop_table(spark, path)
        path = after_path
        if after == before:
            break
        before = after
    return load(path)
