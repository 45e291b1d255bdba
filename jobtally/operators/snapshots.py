"""States kept per period, so that the state at a time needs one of them and the points of one period.

A period is a day unless told otherwise. The store has two tables partitioned by period: the points, and for each period
with points the state at its end, which is the state of the period before brought up to date. Periods are only ever
written whole, so a run that is repeated writes the same; a change of old points rewrites the states from there on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtally.operators.replay import state_at
from jobtally.operators.series import SERIES
from jobtally.operators.skew import CHUNK_SECONDS

POINTS = "timestamp BIGINT, job_id STRING, operation STRING, value BIGINT, period BIGINT"
END = 2**62


class SnapshotStore:
    """Points and their states at the end of each period, below one folder."""

    def __init__(self, spark: SparkSession, path: str, period: int = CHUNK_SECONDS):
        if period < 1:
            raise ValueError("a period has a second at least")
        self.spark, self.path, self.period = spark, path.rstrip("/"), period

    def _read(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema(POINTS).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], POINTS)

    def _write(self, rows: DataFrame, table: str) -> None:
        """Replace the periods that ``rows`` has and leave the others; a large period is cut by size."""
        columns = ["timestamp", *SERIES, "value", "period"]
        out = rows.select(*columns).hint("rebalance", "period").write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{self.path}/{table}")

    def _periods(self, table: str, where: str) -> list[int]:
        """Periods of a table, from the names of its folders."""
        return sorted(r["period"] for r in self._read(table).where(where).select("period").distinct().collect())

    def replace(self, points: DataFrame) -> None:
        """Take in the points of whole periods and bring states up to date from the first of them on.

        One state is computed per period, from the one before it and the period's points: work grows with what changed.
        """
        dated = points.select("timestamp", *SERIES, "value", F.expr(f"timestamp div {self.period}L").alias("period"))
        self._write(dated, "points")
        first = dated.agg(F.min("period")).first()[0]
        if first is None:
            return
        before = self._periods("states", f"period < {first}")
        last = before[-1] if before else None
        for period in self._periods("points", f"period >= {first}"):
            fresh = self._read("points").where(F.col("period") == period)
            known = fresh if last is None else fresh.unionByName(self._read("states").where(F.col("period") == last))
            self._write(state_at(known, END).withColumn("period", F.lit(period).cast("bigint")), "states")
            last = period

    def state_at(self, at: int) -> DataFrame:
        """``replay.state_at`` from the state of the last period that ended by then and the points of the one that runs."""
        running = at // self.period
        ended = self._periods("states", f"period < {running}")
        now = self._read("points").where((F.col("period") == running) & (F.col("timestamp") <= at))
        if ended:
            now = now.unionByName(self._read("states").where(F.col("period") == ended[-1]))
        return state_at(now, at)
