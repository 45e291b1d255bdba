"""Substring dedup: words covered by a run of words that also stands in a document of smaller id.

Fixed blocks anchor the search. Each document is a reference cut into non-overlapping blocks of ``block`` words; a
window of ``2 * block - 1`` or more words always holds a whole block. Every rolling window of ``block`` words probes
the blocks of all documents. Around the hits, and only there, the full windows are compared, and overlapping repeated
windows join to the maximal exact repeats, whose words go.

Probes and blocks travel packed: a task turns a slice of documents into one row per hash bucket with sorted places and
hashes. What recurs among the documents of a slice is settled in the slice, and each such hash is sent on once, so a
passage that a third of all documents hold costs one entry per slice. Hits come back as places in slices.

Windows are compared by two 64-bit hashes. Odd input: null and blank texts have no words; rows with a null id keep all
their words and are no reference; rows that repeat an id are one document with that id and never match each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from jobtally.llm import words as W
from jobtally.llm.tables import apart, buckets, drop_table, inner, write_table

WINDOW, BLOCK = 13, 7
SLICE = 8_000_000
LOW = np.uint64((1 << 48) - 1)
PACKED = "bucket int, slice long, places binary, hashes binary"
HITS = "slice long, doc_ids binary, firsts binary, places binary"


def _number(part: int) -> int:
    """A number for a slice: equal again when the task runs again."""
    return TaskContext.get().partitionId() * (1 << 32) + part


def _runs(h: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the length."""
    return np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h)) if len(h) else np.zeros(1, np.int64)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _probe(batches: Iterator[pa.RecordBatch], block: int, n: int) -> Iterator[pa.RecordBatch]:
    """For each slice: its directory and hits within it (bucket -1), and its probes by bucket.

    A place is twice the number of a window's first word in the slice, plus one where a reference block starts. A
    probe whose hits are settled has its place as the negative.
    """
    part = 0
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("text"), SLICE):
            number, part = _number(part), part + 1
            ids = rows.column("doc_id").to_numpy()
            w = W.words(rows.column("text"))
            at, h = W.windows(w, block)
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            owner = np.searchsorted(w.first, at, side="right") - 1
            starts = (at - w.first[owner]) % block == 0
            runs = _runs(h)
            first, size = runs[:-1], np.diff(runs)
            several = np.zeros(len(first), bool)
            if len(first):
                seen = ids[owner]
                several = np.minimum.reduceat(seen, first) != np.maximum.reduceat(seen, first)
            in_several = np.repeat(several, size)
            settled = np.sort(at[in_several])
            lead = first[several]
            has_block = np.logical_or.reduceat(starts, first)[several] if len(first) else several
            places = np.concatenate([2 * at[~in_several] + starts[~in_several], -(2 * at[lead] + has_block) - 1])
            hashes = np.concatenate([h[~in_several], h[lead]])
            where = _bucket(hashes, n)
            order = np.lexsort((np.abs(places), where))
            places, hashes, where = places[order].astype(np.int32), hashes[order], where[order]
            edge = np.searchsorted(where, np.arange(n + 1))
            full = np.flatnonzero(np.diff(edge))
            low = (hashes & LOW).view(np.uint8).reshape(-1, 8)[:, :6]
            cut = [slice(edge[i], edge[i + 1]) for i in full]
            directory = ids.astype(np.int64).tobytes(), w.first.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([full, [-1, -2]]).astype(np.int32)),
                    pa.array(np.full(len(full) + 2, number, np.int64)),
                    pa.array([*[np.diff(places[c], prepend=np.int32(0)).tobytes() for c in cut], directory[0], settled.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([*[low[c].tobytes() for c in cut], directory[1], b""], pa.binary()),
                ],
                ["bucket", "slice", "places", "hashes"],
            )


def _passed(bucket: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Directories (-1) and settled places (-2) as they came."""
    if bucket == -1:
        return pd.DataFrame({"slice": rows["slice"], "doc_ids": rows["places"], "firsts": rows["hashes"], "places": None})
    return pd.DataFrame({"slice": rows["slice"], "doc_ids": None, "firsts": None, "places": rows["places"]})


def _by_slice(numbers: np.ndarray, source: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """One row per slice with the places that came from it."""
    order = np.argsort(source, kind="stable")
    source, places = source[order], places[order].astype(np.int64)
    edge = _runs(source)
    cut = [places[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    return pd.DataFrame({"slice": numbers[source[edge[:-1]]].astype(np.int64), "doc_ids": None, "firsts": None, "places": cut})


def _answer(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Places of a bucket's probes that hit a block in another slice, by slice."""
    if key[0] < 0:
        return _passed(key[0], rows)
    places = [np.cumsum(np.frombuffer(b, np.int32), dtype=np.int32) for b in rows["places"]]
    source = np.repeat(np.arange(len(places)), [len(p) for p in places])
    places = np.concatenate(places)
    wide = np.zeros((len(places), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(rows["hashes"]), np.uint8).reshape(-1, 6)
    h = wide.view(np.uint64)[:, 0]
    order = np.argsort(h, kind="stable")
    h, places, source = h[order], places[order], source[order]
    runs = _runs(h)
    first, size = runs[:-1], np.diff(runs)
    settled = places < 0
    plain = np.where(settled, -(places + 1), places)
    # Probes of one slice are in order of slices: a run has several sources if its ends differ. A single document
    # with the same words twice is one slice; documents that were cut apart are others.
    hit = (source[first] != source[np.maximum(runs[1:], 1) - 1]) & np.logical_or.reduceat(plain % 2 == 1, first)
    mine = np.repeat(hit, size) & ~settled
    return _by_slice(rows["slice"].to_numpy(), source[mine], plain[mine] // 2)


def _by_document(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Word numbers in the documents of one slice at which anchors stand."""
    directory = rows[rows["doc_ids"].notna()].iloc[0]
    ids, firsts = np.frombuffer(directory["doc_ids"], np.int64), np.frombuffer(directory["firsts"], np.int64)
    places = np.unique(np.frombuffer(b"".join(b for b in rows["places"] if b is not None), np.int64))
    owner = np.searchsorted(firsts, places, side="right") - 1
    edge = _runs(owner)
    own = owner[edge[:-1]]
    local = places - firsts[owner]
    return pd.DataFrame({"doc_id": ids[own], "places": [local[a:b].astype(np.int32).tobytes() for a, b in zip(edge[:-1], edge[1:])]})


def _resolve(packed: DataFrame, decide) -> DataFrame:
    """(doc_id, places): what ``decide`` finds in each bucket, brought back to the documents."""
    # Directories and settled places pass through, dealt by slice.
    dealt = packed.withColumn("deal", F.when(F.col("bucket") < 0, F.col("slice")).otherwise(F.lit(0).cast("long")))
    hits = dealt.groupBy("bucket", "deal").applyInPandas(decide, HITS)
    return hits.groupBy("slice").applyInPandas(_by_document, "doc_id long, places binary")


def anchors(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, anchors): words where ``block`` words start that recur around a reference block elsewhere."""
    n = buckets(docs.sparkSession)
    packed = docs.mapInArrow(lambda batches: _probe(batches, block, n), PACKED)
    return _resolve(packed, _answer).withColumnRenamed("places", "anchors")


def _merged(blobs) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(bytes(b) for b in blobs), np.int32)) if blobs else np.zeros(0, np.int32)


def _extend(batches: Iterator[pa.RecordBatch], window: int, block: int, n: int) -> Iterator[pa.RecordBatch]:
    """Windows around anchors, packed like probes: settled ones (bucket -2), others by bucket for the smallest id."""
    part = 0
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("text"), SLICE):
            number, part = _number(part), part + 1
            ids = rows.column("doc_id").to_numpy()
            w = W.words(rows.column("text"))
            near = np.zeros(len(w.hashes) + 1, np.int64)
            for i, blobs in enumerate(rows.column("anchors").to_pylist()):
                own = _merged(blobs)
                own = own[own < w.first[i + 1] - w.first[i]] + w.first[i]
                np.add.at(near, np.maximum(own - (window - block), w.first[i]), 1)
                np.subtract.at(near, own + 1, 1)
            at, one = W.windows(w, window, 1)
            two = W.windows(w, window, 2)[1]
            use = np.cumsum(near)[at] > 0
            at, one, two = at[use], one[use], two[use]
            seen = ids[np.searchsorted(w.first, at, side="right") - 1]
            order = np.lexsort((at, seen, two, one))
            at, one, two, seen = at[order], one[order], two[order], seen[order]
            gone = seen > _least_id(one, two, seen)
            settled = np.sort(at[gone])
            at, one, two, seen = at[~gone], one[~gone], two[~gone], seen[~gone]
            where = _bucket(one, n)
            edge = np.searchsorted(where, np.arange(n + 1))  # buckets follow the order of ``one``
            full = np.flatnonzero(np.diff(edge))
            cut = [slice(edge[i], edge[i + 1]) for i in full]
            keys = np.stack([one, two, seen.view(np.uint64)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([full, [-1, -2]]).astype(np.int32)),
                    pa.array(np.full(len(full) + 2, number, np.int64)),
                    pa.array([*[at[c].astype(np.int32).tobytes() for c in cut], ids.astype(np.int64).tobytes(), settled.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([*[keys[c].tobytes() for c in cut], w.first.astype(np.int64).tobytes(), b""], pa.binary()),
                ],
                ["bucket", "slice", "places", "hashes"],
            )


def _least_id(one: np.ndarray, two: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For windows in order of both hashes and id: the smallest id that has the same window."""
    new = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.zeros(0, np.int64)
    return np.repeat(seen[new], np.diff(np.append(new, len(one))))


def _decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Places of a bucket's windows whose words also start in a document of smaller id, by slice."""
    if key[0] < 0:
        return _passed(key[0], rows)
    keys = np.frombuffer(b"".join(rows["hashes"]), np.uint64).reshape(-1, 3)
    one, two, seen = keys[:, 0], keys[:, 1], keys[:, 2].view(np.int64)
    places = np.frombuffer(b"".join(rows["places"]), np.int32)
    source = np.repeat(np.arange(len(rows)), [len(b) // 4 for b in rows["places"]])
    order = np.lexsort((seen, two, one))
    gone = order[seen[order] > _least_id(one[order], two[order], seen[order])]
    return _by_slice(rows["slice"].to_numpy(), source[gone], places[gone])


def covered(docs: DataFrame, found: DataFrame, window: int, block: int) -> DataFrame:
    """(doc_id, starts): blobs of the windows of each document that stand in one of smaller id."""
    n = buckets(docs.sparkSession)
    gathered = found.groupBy("doc_id").agg(F.collect_list("anchors").alias("anchors"))
    around = docs.join(gathered, "doc_id").select("doc_id", "text", "anchors")
    packed = around.mapInArrow(lambda batches: _extend(batches, window, block, n), PACKED)
    return _resolve(packed, _decide).groupBy("doc_id").agg(F.collect_list("places").alias("starts"))


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Adds the text without the covered words, the kept words joined by a space, and both counts."""
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("__text"), SLICE):
            texts, starts = rows.column("__text"), rows.column("__starts").to_pylist()
            left, kept, n_words, n_removed = [], [], [], []
            for i, text in enumerate(texts):
                text = text.as_py()
                raw = (text or "").encode()
                found = raw.split()
                own = _merged(starts[i])
                own = own[own <= len(found) - window]
                cover = np.zeros(len(found) + 1, np.int32)
                cover[own] += 1
                cover[own + window] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                n_words.append(len(found))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(found, gone.tolist()) if not g]).decode() if n_removed[-1] else b" ".join(found).decode())
                left.append(_cut(raw, gone) if n_removed[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], pa.array(left, pa.string()), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                [*rows.schema.names[:-1], "__left", "__kept", "__n_words", "__n_removed"],
            )


def _cut(raw: bytes, gone: np.ndarray) -> str:
    """The text without the words marked, each with the white space after it."""
    data = np.frombuffer(raw, np.uint8)
    starts, _ = W.spans(data, np.array([0, len(data)]))
    keep = np.ones(len(data), bool)
    until = np.append(starts[1:], len(data))
    for s, e in zip(starts[gone], until[gone]):
        keep[s:e] = False
    return data[keep].tobytes().decode().rstrip(" \t\n\r\v\f") if gone[-1] else data[keep].tobytes().decode()


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All rows and columns, with ``__left`` (the text without repeats), ``__kept`` (the kept words, single spaces),
    ``__n_words`` and ``__n_removed``."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block")
    spark = docs.sparkSession
    own = inner(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    anchored = write_table(anchors(own, block), "anchors")
    hits = spark.read.schema("doc_id long, anchors binary").parquet(anchored)
    where = write_table(covered(own, hits, window, block), "covered")
    drop_table(spark, anchored)
    starts = spark.read.schema("doc_id long, starts array<binary>").parquet(where).select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    joined = docs.join(starts, F.col(f"`{id_col}`").cast("long") == F.col("__id"), "left").select(*columns, F.col(f"`{text_col}`").alias("__text"), "__starts")
    added = [StructField("__text", StringType()), StructField("__left", StringType()), StructField("__kept", StringType()), StructField("__n_words", LongType()), StructField("__n_removed", LongType())]
    return joined.mapInArrow(lambda batches: _remove(batches, window), StructType([*docs.schema.fields, *added])).drop("__text")


@apart
def clean(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with repeats taken out of their texts."""
    found = remove_repeats(docs, id_col, text_col)
    return found.select(*[(F.col("__left") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
