"""Writers of peaks: a store in generations, and one JSON document.

The store is a folder of three things. ``log`` holds the peaks of the batches written since the last fold, a folder per
batch; ``gen=N`` holds all peaks up to a batch, folded; ``CURRENT`` is a small file that names the generation in force and
the last batch it covers. Every so many batches the log is folded with the generation in force into the next one, and
``CURRENT`` is replaced in one step. Before that step readers see the old generation and the whole log, after it the new
one; a fold keeps the largest, so rows that are in both change nothing. What the *former* generation covered is deleted
then, not what the new one does: a reader that began before the step still finds its files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtally.operators.peaks import PEAK_JOBS, PEAK_OPS, fold_peak_jobs, fold_peak_ops

KINDS = {"ops": (PEAK_OPS, fold_peak_ops), "jobs": (PEAK_JOBS, fold_peak_jobs)}
POINTER = "CURRENT"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    files = _files(spark, path)
    if not files.exists(_path(spark, path)):
        return []
    return [status.getPath().getName() for status in files.listStatus(_path(spark, path))]


@dataclass(frozen=True)
class Generation:
    """What ``CURRENT`` says: the generation in force, the last batch it covers, and that of the one before."""

    number: int = -1
    through: int = -1
    before: int = -1


class PeakStore:
    """All-time peaks that batches are added to; the number of files stays bounded however many there are."""

    def __init__(self, path: str, fold_every: int = 20):
        if fold_every < 1:
            raise ValueError("fold_every must be at least 1")
        self.path, self.fold_every = path.rstrip("/"), fold_every

    def current(self, spark: SparkSession) -> Generation:
        if POINTER not in _names(spark, self.path):
            return Generation()
        text = spark.read.text(f"{self.path}/{POINTER}", wholetext=True).first()[0]
        return Generation(**json.loads(text))

    def _switch(self, spark: SparkSession, to: Generation) -> None:
        """Replace ``CURRENT`` in one step: a reader finds the old text or the new one."""
        fresh = _path(spark, f"{self.path}/{POINTER}.{to.number}")
        out = _files(spark, self.path).create(fresh, True)
        out.write(bytearray(json.dumps(vars(to)).encode()))
        out.close()
        hadoop = spark._jvm.org.apache.hadoop.fs
        overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        target = _path(spark, f"{self.path}/{POINTER}")
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, overwrite)

    def _batches(self, spark: SparkSession) -> list[int]:
        return sorted(int(name.partition("=")[2]) for name in _names(spark, f"{self.path}/log") if name.startswith("batch="))

    def add(self, ops: DataFrame, jobs: DataFrame, batch_id: int) -> None:
        """Add the peaks of a batch; one that is added again takes the place of its first try.

        Both tables have a row per operation at most, hence one file each.
        """
        spark = ops.sparkSession
        for kind, rows in (("ops", ops), ("jobs", jobs)):
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_id}/{kind}")
        if sum(batch > self.current(spark).through for batch in self._batches(spark)) >= self.fold_every:
            self.fold(spark)

    def fold(self, spark: SparkSession) -> None:
        """Put all peaks so far into a new generation and delete what the former one covered."""
        old = self.current(spark)
        batches = self._batches(spark)
        if not batches or batches[-1] <= old.through:
            return
        new = Generation(old.number + 1, batches[-1], old.through)
        for kind, rows in zip(KINDS, self.read(spark), strict=True):
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/gen={new.number}/{kind}")
        self._switch(spark, new)
        self._clean(spark, new)

    def _clean(self, spark: SparkSession, now: Generation) -> None:
        files = _files(spark, self.path)
        for batch in self._batches(spark):
            if batch <= now.before:
                files.delete(_path(spark, f"{self.path}/log/batch={batch}"), True)
        for name in _names(spark, self.path):
            if name.startswith("gen=") and int(name.partition("=")[2]) < now.number - 1:
                files.delete(_path(spark, f"{self.path}/{name}"), True)

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Peaks of operations and of jobs so far, empty before the first batch."""
        now = self.current(spark)
        base = [f"{self.path}/gen={now.number}"] if now.number >= 0 else []
        parts = base + [f"{self.path}/log/batch={batch}" for batch in self._batches(spark) if batch > now.through]
        found = []
        for kind, (schema, fold) in KINDS.items():
            whole = [f"{part}/{kind}" for part in parts if "_SUCCESS" in _names(spark, f"{part}/{kind}")]
            found.append(fold(spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)))
        return tuple(found)


def write_peaks(ops: DataFrame, jobs: DataFrame, path: str) -> None:
    """Append peaks to a plain folder; it is never rewritten, readers fold it. ``PeakStore`` is for streams."""
    ops.coalesce(1).write.mode("append").parquet(f"{path}/ops")
    jobs.coalesce(1).write.mode("append").parquet(f"{path}/jobs")


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Put a complete folder in the place of another; at any moment one of the two is there whole."""
    target, fresh, old = _path(spark, path), _path(spark, new), _path(spark, f"{path}.old")
    files = _files(spark, path)
    files.delete(old, True)
    if files.exists(target):
        files.rename(target, old)
    files.rename(fresh, target)
    files.delete(old, True)


def write_peaks_json(ops: DataFrame, jobs: DataFrame, path: str) -> None:
    """Peaks as one JSON document; both tables have 28 rows at most.

    The document is written beside ``path`` and takes its place when complete, so peaks that were read from
    ``path`` can be folded and written back to it.
    """
    entry = lambda value: F.map_from_entries(F.collect_list(F.struct("operation", value)))
    top_ops = ops.select(entry(F.struct("rate", "timestamp"))).scalar()
    top_jobs = jobs.select(entry(F.struct("job_id", "ops", "timestamp"))).scalar()
    one = ops.sparkSession.range(1)
    one.select(F.to_json(F.struct(top_ops.alias("top_ops"), top_jobs.alias("top_job_per_op"))).alias("value")).write.mode(
        "overwrite"
    ).text(f"{path}.new")
    _swap(ops.sparkSession, f"{path}.new", path)
