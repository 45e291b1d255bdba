"""Which sinks have taken which batch, so that a batch that is run again goes only to those that failed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

KEPT = 3  # batches; only the latest is ever run again


class SinkLedger:
    """An empty file per batch and sink, made when the sink has returned.

    A sink that had written and then lost the driver before its file was made is run again: sinks keyed by batch take
    that, as they do without a ledger.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _path(self, spark: SparkSession, *names: str):
        return spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _list(self, spark: SparkSession, *names: str) -> list[str]:
        folder = self._path(spark, *names)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []

    def done(self, spark: SparkSession, batch_id: int) -> set[str]:
        """Names of the sinks that have the batch, quoted as in file names."""
        return set(self._list(spark, f"batch={batch_id}"))

    def bound(self, spark: SparkSession, sinks: Mapping[str, Callable], batch_id: int) -> dict[str, Callable[[DataFrame], None]]:
        """The sinks that do not have the batch yet, each noting when it does."""
        done = self.done(spark, batch_id)

        def noting(name: str, sink: Callable) -> Callable[[DataFrame], None]:
            def write(df: DataFrame) -> None:
                sink(df, batch_id)
                mark = self._path(spark, f"batch={batch_id}", quote(name, safe=""))
                mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()

            return write

        return {name: noting(name, sink) for name, sink in sinks.items() if quote(name, safe="") not in done}

    def forget(self, spark: SparkSession, batch_id: int) -> None:
        """Let all sinks take a batch anew."""
        folder = self._path(spark, f"batch={batch_id}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    def trim(self, spark: SparkSession, batch_id: int) -> None:
        """Drop what was noted of batches long gone."""
        for name in self._list(spark):
            if int(name.partition("=")[2]) <= batch_id - KEPT:
                self.forget(spark, int(name.partition("=")[2]))
