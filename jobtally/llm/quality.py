"""Quality rules: counts within a document, and lines that too many documents of a host share.

A line is normalised by lower-casing A-Z and ignoring the kind and amount of white space. For each host (``source``)
and line the *different* documents that hold it are counted: copies of one document count once, and documents differ
when any byte does. Lines in more documents than ``share`` of the host's different documents, and in more than
``least``, are removed. A document is depleted when fewer than ``min_words`` words or less than ``min_left`` of
its words remain.

Odd input: a null text is empty, a null host is a host of its own, null and repeated ids are judged row by row, other
columns are ignored by ``judge`` and kept by ``clean``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from jobtally.llm import words as W
from jobtally.llm.tables import apart, inner, materialise

SLICE = 4_000_000
SALTS = 16
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = "doc_id long, host string, digest long, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<h:long,words:int>>"


@dataclass(frozen=True)
class Limits:
    share: float = 0.1
    least: int = 20
    min_words: int = 10
    min_left: float = 0.2


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def line_hashes(w: W.Words, lower: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Lines with a word: starts, ends, texts that own them, numbers of words and normalised hashes."""
    starts, ends = W.spans(data, offsets, _NEWLINE)
    first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    full = last > first
    starts, ends, first, last = starts[full], ends[full], first[full], last[full]
    place = np.arange(len(lower), dtype=np.int64) - np.repeat(first, last - first)
    powers = np.full(int(place.max(initial=0)) + 1, W.BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower * powers[place], dtype=np.uint64)])
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, owner, last - first, W.mix(sums[last] - sums[first])


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text")
    n = batch.num_rows
    data, offsets = W.raw(texts)
    w = W.words(texts)
    lower = W.span_hashes(data, w.starts, w.ends, lower=True)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[w.starts] += 1
    np.subtract.at(inside, w.ends, 1)
    in_word = np.cumsum(inside[:-1])
    word_chars = _per_text(in_word * ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_text(_SYMBOL[data], offsets)
    starts, ends, owner, size, h = line_hashes(w, lower, data, offsets)
    salt = W.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(W.BASE))
    exact = np.unique(W.span_hashes(data, starts, ends) + salt[owner], return_index=True)[1]
    n_dup = np.bincount(owner, minlength=n) - np.bincount(owner[exact], minlength=n)
    at, five = W.windows(w, 5)
    owners = w.owners()
    _, which, times = np.unique(five + salt[owners[at]], return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    cover = np.zeros(len(owners) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, twice + 5, 1)
    n_repeat = np.bincount(owners[np.cumsum(cover[:-1]) > 0], minlength=n)
    order = np.lexsort((h, owner))
    h, owner, size = h[order], owner[order], size[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    group = np.flatnonzero(new)
    total = np.add.reduceat(size, group) if len(group) else size[:0]
    h, owner = h[group], owner[group]
    lines = np.bincount(owner, minlength=n)
    edge = np.concatenate([[0], np.cumsum(lines)])
    items = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(total.astype(np.int32))], ["h", "words"])
    counts = [w.counts, word_chars, n_symbols, n_dup, n_repeat]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("host"), batch.column("digest"), *[pa.array(c.astype(np.int64)) for c in counts], pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), items)],
        ["doc_id", "host", "digest", *COUNTS, "lines"],
    )


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, batch.schema.get_field_index("text"), SLICE):
            yield _features(part)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def frequent_lines(features: DataFrame, limits: Limits) -> DataFrame:
    """Host and line of every line above the limits, with the number of different documents."""
    hosts = features.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    lines = features.select("host", "digest", F.explode("lines").alias("line")).select("host", "line.h", "digest")
    held = lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("held_by")).where(F.col("held_by") > limits.least)
    return held.join(hosts, "host").where(F.col("held_by") > limits.share * F.col("documents")).select("host", "h", "held_by")


def judge(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``removed_words``, ``bad_lines`` and ``kept``."""
    picked = inner(docs, doc_id=id_col, text=text_col, host=host_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("host").cast("string"), F.lit("\0")).alias("host"), F.xxhash64("text").alias("digest"), "text"
    )
    features = materialise(picked.mapInArrow(_map_features, SCHEMA), "quality")
    bad = frequent_lines(features, limits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A line above the limits is in many rows: salted, its rows are dealt to several tasks.
    rows = features.select("doc_id", "digest", "host", F.explode("lines").alias("line")).select("doc_id", "digest", "host", "line.h", "line.words")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
    hits = rows.join(bad, ["host", "h", "salt"]).distinct()
    # Equal rows have equal verdicts, which are joined to each of them once.
    removed = hits.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of"), F.col("host").alias("at")).agg(F.sum("words").alias("removed_words"), F.collect_set("h").alias("bad_lines"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")) & (F.col("host") == F.col("at"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        features.drop("lines")
        .join(removed, same, "left")
        .drop("id", "of", "at")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (left >= limits.min_words) & (left >= limits.min_left * F.col("n_words")))
    )


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("__text"))
        bad = batch.column(batch.schema.get_field_index("__bad")).to_pylist()
        out = texts.to_pylist()
        for i in [i for i, hashes in enumerate(bad) if hashes]:
            one = texts.slice(i, 1)
            data, offsets = W.raw(one)
            w = W.words(one, lower=True)
            starts, ends, _, _, h = line_hashes(w, w.hashes, data, offsets)
            gone = np.isin(h.view(np.int64), np.array(bad[i], np.int64))
            keep = np.ones(len(data), bool)
            for s, e in zip(starts[gone], ends[gone]):
                keep[s : min(e + 1, len(data))] = False  # with its line end
            out[i] = data[keep].tobytes().decode()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], "__text"])


@apart
def clean(docs: DataFrame, limits: Limits = Limits(), id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """The kept documents with all their columns, lines above the limits taken out of the text."""
    verdict = judge(docs, limits, id_col, text_col, host_col).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("host").alias("__host"), F.col("bad_lines").alias("__bad")
    ).dropDuplicates(["__id", "__digest", "__host"])
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("\0"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text_col}`") == F.col("__digest")) & (host == F.col("__host"))
    held = docs.join(verdict, same).drop("__id", "__digest", "__host")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    shaped = held.select(*columns, F.col("__bad"), F.col(f"`{text_col}`").alias("__text"))
    schema = StructType([*docs.schema.fields, StructField("__text", StringType())])
    out = shaped.mapInArrow(_without_lines, schema)
    return out.select(*[(F.col("__text") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])
