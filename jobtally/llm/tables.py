"""Tables on the folder that all executors share, and guards for odd input."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str, rows: int = 0) -> str:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir``, in files of at most ``rows`` rows if given; returns its path.

    A task that reads a file may hold all of its rows at once, so packed rows of many megabytes need such a bound.

    Shuffle files of the write go when it ends: the table replaces them, also after the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # Same plan in a new execution, which then takes the setting.
        df.select("*").write.option("maxRecordsPerFile", rows).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return path


def materialise(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """``df`` cut from its lineage by a written table."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, rows))


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``write_table`` that a later one replaces."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def inner(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no extra column can clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def apart(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For stages that return the caller's columns: columns that begin like their own, with ``__``, get other names meanwhile."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        given = {value for value in (*args, *named.values()) if isinstance(value, str)}
        theirs = [c for c in docs.columns if c.startswith("__") and c not in given]
        prefix = "callers_"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_"
        away = {c: f"{prefix}{n}" for n, c in enumerate(theirs)}
        return stage(docs.withColumnsRenamed(away), *args, **named).withColumnsRenamed({new: c for c, new in away.items()})

    return run


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies; clusters ship it with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def buckets(spark: SparkSession, each: int = 4) -> int:
    """Number of hash buckets: follows the shuffle partitions, hence the size of the cluster's job."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
