"""Centroid clustering in which each cluster keeps its vectors in a heap of bounds (Lloyd's rounds, exact).

A scanned vector knows its gap: the distance to the second nearest centroid less that to its own. When centroids move,
the gaps of a cluster shrink by its own move and the largest move of another at most; this drift is added up per
cluster. A heap orders vectors by gap plus the drift at their last scan, so the vectors whose gap may have expired are
at its top: only they are popped, compared with all centroids in whole numbers, and pushed anew.

Vectors are packed into slices of a few thousand. Slices and their heaps are two tables bucketed by slice, so a round
joins them without moving a vector and writes heaps only. What reaches the driver is one sum per centroid component.

Odd input: vectors with another number of components, a null or a value that is not finite are left out, and nothing is
returned for them. Equal distances go to the smaller number. Rows that repeat a vec_id are vectors of their own, seeds
among them ordered by components; a null id counts as empty text in the order of seeds. With fewer vectors than
centroids each vector is a seed; an empty table gives an empty result. Components beyond 2**27 after scaling raise a
ValueError, as squared distances would not fit a long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally.llm.tables import drop_table, inner, materialise
from jobtally.session import shared_dir

SLICE = 4096  # vectors
SLICES = 64  # of a bucket, some 64 MB at most
LARGEST = 1 << 27
SLACK = 1e-5  # beyond the rounding of any distance

PACKED = "slice long, ids array<bigint>, width int, data binary, seeds array<struct<hash:string,components:array<int>>>"
HEAPS = "slice long, cluster binary, sizes array<int>, keys binary, rows binary, scanned long, change binary"


def _components(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and their whole components."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    usable = np.flatnonzero((np.diff(offsets) == dims) & np.asarray(column.is_valid()))
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = values[offsets[:-1][usable][:, None] + np.arange(dims)]
    finite = np.isfinite(rows).all(axis=1)
    whole = np.floor(rows[finite] * scale)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} after scaling")
    return usable[finite], whole.astype(np.int32)


def _pack(dims: int, scale: float, k: int, seed: str):
    def row(number: int, ids: list, rows: np.ndarray) -> dict:
        width = next(w for w in (1, 2, 4) if not rows.size or np.abs(rows).max() < 1 << (8 * w - 1))
        hashes = [hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest() for i in ids]
        least = heapq.nsmallest(k, range(len(ids)), key=lambda at: (hashes[at], rows[at].tolist()))
        return {
            "slice": TaskContext.get().partitionId() << 32 | number,
            "ids": ids,
            "width": width,
            "data": rows.astype(f"<i{width}").tobytes(),
            "seeds": [{"hash": hashes[at], "components": rows[at].tolist()} for at in least],
        }

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, held = 0, [], [], 0
        for batch in batches:
            places, rows = _components(batch.column(1), dims, scale)
            own = batch.column(0).take(pa.array(places)).to_pylist()
            at = 0
            while at < len(own):
                more = min(SLICE - held, len(own) - at)
                ids += own[at : at + more]
                parts.append(rows[at : at + more])
                held, at = held + more, at + more
                if held == SLICE:
                    yield pa.RecordBatch.from_pylist([row(number, ids, np.concatenate(parts))], _PACKED)
                    number, ids, parts, held = number + 1, [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([row(number, ids, np.concatenate(parts))], _PACKED)

    return pack


_PACKED = pa.schema(
    [
        ("slice", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("width", pa.int32()),
        ("data", pa.binary()),
        ("seeds", pa.list_(pa.struct([("hash", pa.string()), ("components", pa.list_(pa.int32()))]))),
    ]
)
_HEAPS = pa.schema(
    [
        ("slice", pa.int64()),
        ("cluster", pa.binary()),
        ("sizes", pa.list_(pa.int32())),
        ("keys", pa.binary()),
        ("rows", pa.binary()),
        ("scanned", pa.int64()),
        ("change", pa.binary()),
    ]
)
_ROWS = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centroid, exact."""
    rows, centroids = rows.astype(np.int64), centroids.astype(np.int64)
    most = max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if int(most) ** 2 * rows.shape[1] < 1 << 52 else np.int64  # sums that doubles hold exactly
    products = (rows.astype(kind) @ centroids.T.astype(kind)).astype(np.int64)
    return (rows * rows).sum(axis=1)[:, None] - 2 * products + (centroids * centroids).sum(axis=1)


def scan(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the gap to the second nearest."""
    squared = distances(rows, centroids)
    nearest = squared.argmin(axis=1)
    at = np.arange(len(rows))
    own = np.sqrt(squared[at, nearest].astype(np.float64))
    if len(centroids) == 1:
        return nearest, np.full(len(rows), np.inf)
    squared[at, nearest] = np.iinfo(np.int64).max
    return nearest, np.sqrt(squared.min(axis=1).astype(np.float64)) - own


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much the gaps of each cluster shrink at most as centroids move."""
    moved = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1))
    others = [max([*moved[:c], *moved[c + 1 :]], default=0.0) for c in range(len(moved))]
    return moved + np.array(others)


class Heaps:
    """The bounds of one slice: a heap of (gap + drift at the scan, row) for each cluster."""

    def __init__(self, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.cluster, self.heaps = cluster, heaps

    @classmethod
    def load(cls, row: dict) -> Heaps:
        keys, rows = np.frombuffer(row["keys"], "<f8").tolist(), np.frombuffer(row["rows"], "<i4").tolist()
        ends = np.cumsum([0, *row["sizes"]])
        heaps = [list(zip(keys[a:b], rows[a:b], strict=True)) for a, b in zip(ends, ends[1:])]
        return cls(np.frombuffer(row["cluster"], "<i4").copy(), heaps)

    def columns(self) -> dict:
        flat = [entry for heap in self.heaps for entry in heap]
        return {
            "cluster": self.cluster.astype("<i4").tobytes(),
            "sizes": [len(heap) for heap in self.heaps],
            "keys": np.array([key for key, _ in flat], "<f8").tobytes(),
            "rows": np.array([row for _, row in flat], "<i4").tobytes(),
        }

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pop the rows whose gap the drift of their cluster may have used up."""
        popped = []
        for heap, used in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= used + SLACK:
                popped.append(heapq.heappop(heap)[1])
        return np.array(popped, np.int64)

    def push(self, rows: np.ndarray, nearest: np.ndarray, gaps: np.ndarray, drift: np.ndarray) -> None:
        self.cluster[rows] = nearest
        for row, at, key in zip(rows.tolist(), nearest.tolist(), (gaps + drift[nearest]).tolist(), strict=True):
            heapq.heappush(self.heaps[at], (key, row))


def _vectors(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["data"], f"<i{row['width']}").reshape(-1, dims)


def settle(row: dict, dims: int, centroids: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, int]:
    """Bring a slice up to the current centroids: its heaps, what sums and counts of clusters change by, rows scanned."""
    vectors, k = _vectors(row, dims), len(centroids)
    if row.get("cluster") is None:
        heaps, due = Heaps(np.full(len(vectors), -1, np.int32), [[] for _ in range(k)]), np.arange(len(vectors))
    else:
        heaps = Heaps.load(row)
        due = heaps.expired(drift)
    nearest, gaps = scan(vectors[due], centroids)
    old = heaps.cluster[due]
    heaps.push(due, nearest, gaps, drift)
    change = np.zeros((k, dims + 1), np.int64)
    moved = np.flatnonzero(old != nearest)
    counted = np.column_stack([vectors[due[moved]].astype(np.int64), np.ones(len(moved), np.int64)])
    np.add.at(change, nearest[moved], counted)
    left = old[moved] >= 0
    np.subtract.at(change, old[moved][left], counted[left])
    return heaps, change, len(due)


def _round(dims: int, centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                heaps, change, scanned = settle(row, dims, centroids, drift)
                out = heaps.columns() | {"slice": row["slice"], "scanned": scanned, "change": change.tobytes()}
                yield pa.RecordBatch.from_pylist([out], _HEAPS)

    return run


def _last(dims: int, centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                heaps, _, _ = settle(row, dims, centroids, drift)
                away = _vectors(row, dims).astype(np.int64) - centroids[heaps.cluster]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(heaps.cluster), pa.array((away * away).sum(axis=1))],
                    schema=_ROWS,
                )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of a task's slices in one row."""
    total, scanned = None, 0
    for batch in batches:
        scanned += sum(batch.column(1).to_pylist())
        for change in batch.column(0).to_pylist():
            change = np.frombuffer(change, np.int64)
            total = change if total is None else total + change
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([scanned])], ["change", "scanned"])


@dataclass
class Bucketed:
    """Tables bucketed by slice below the shared folder, to be joined in place."""

    spark: SparkSession
    buckets: int
    paths: dict[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame, name: str) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        self.paths[table] = f"{shared_dir(self.spark)}/{table}"
        df.write.format("parquet").bucketBy(self.buckets, "slice").sortBy("slice").option("path", self.paths[table]).saveAsTable(table)
        return table

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        drop_table(self.spark, self.paths[table])


@dataclass
class Clustering:
    rows: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray
    scanned: list[int]  # vectors compared with all centroids, in each round


def _sums(heaps: DataFrame, k: int, dims: int) -> tuple[np.ndarray, int]:
    """Changes of all slices, as Python integers."""
    tasks = heaps.select("change", "scanned").mapInArrow(_added, "change array<bigint>, scanned long")
    cells = tasks.select("scanned", F.posexplode("change").alias("at", "change"))
    found = cells.groupBy("at").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"), F.sum("scanned").alias("scanned")).collect()
    total = np.zeros(k * (dims + 1), object)
    for cell in found:
        total[cell["at"]] = int(cell["change"])
    return total.reshape(k, dims + 1), int(found[0]["scanned"]) if found else 0


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1:",
    id_column: str = "vec_id", column: str = "embedding",
) -> Clustering:
    """Assign vectors to ``k`` centroids after ``rounds`` rounds of assignment and replacement.

    Components are floor(scale * x). The first centroids are the vectors whose SHA-256 of ``seed`` and id is least. A
    replaced centroid is the floor of the mean of its vectors, by component; one without vectors stays.
    """
    spark = vectors.sparkSession
    count = vectors.count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = math.ceil(count / SLICE)
    buckets = max(1, math.ceil(slices / SLICES), min(slices, partitions))
    tables = Bucketed(spark, buckets)
    packed = inner(vectors, vec_id=id_column, embedding=column).mapInArrow(_pack(dims, scale, k, seed), PACKED)
    data = tables.write(packed.repartition(buckets, "slice"), "op12_vectors")
    seeds = spark.table(data).select(F.inline("seeds")).orderBy("hash", "components").limit(k).collect()
    if not seeds:
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64), [])
    centroids = np.array([s["components"] for s in seeds], np.int64)
    k = len(centroids)
    drift, sums, scanned, heaps = np.zeros(k), np.zeros((k, dims + 1), object), [], None
    slices = spark.table(data).select("slice", "ids", "width", "data")

    def with_heaps():
        known = ["cluster", "sizes", "keys", "rows"]
        return slices if heaps is None else slices.join(spark.table(heaps).select("slice", *known), "slice")

    for _ in range(rounds):
        old, heaps = heaps, tables.write(with_heaps().mapInArrow(_round(dims, centroids, drift), HEAPS), "op12_heaps")
        if old:
            tables.drop(old)
        change, seen = _sums(spark.table(heaps), k, dims)
        sums, scanned = sums + change, [*scanned, seen]
        moved = np.array([[s // row[dims] for s in row[:dims]] if row[dims] else old_row for row, old_row in zip(sums, centroids.tolist())], np.int64)
        drift, centroids = drift + drifts(centroids, moved), moved
    rows = with_heaps().mapInArrow(_last(dims, centroids, drift), "vec_id long, cluster int, distance long")
    rows = materialise(rows, "op12-rows")
    if heaps:
        tables.drop(heaps)
    tables.drop(data)
    return Clustering(rows, centroids, scanned)


def with_inertia(found: Clustering) -> DataFrame:
    """Rows with the distances summed over their cluster and over all, and a digest of their centroid."""
    spark = found.rows.sparkSession
    own = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per centroid
    total = sum(r["cluster_inertia"] for r in own)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(r["cluster"], r["cluster_inertia"], total, digest(found.centroids[r["cluster"]])) for r in own]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return found.rows.join(F.broadcast(spark.createDataFrame(facts, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
