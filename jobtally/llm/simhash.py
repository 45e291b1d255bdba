"""Near-duplicates by SimHash: 64-bit fingerprints, blocks that close pairs must share, Hamming distance.

A fingerprint is taken over a text's word shingles (A-Z lower-cased, repeats included); a bit is set when it is set in
more than half of the shingles' XXH64 values. Two fingerprints that differ in at most three bits agree in at least
three of six blocks, so each fingerprint is filed under the 20 choices of three blocks (about 32 bits each) and only
fingerprints filed together are compared. Each group of equal fingerprints takes part once, so copies cost nothing.

Within a file of up to ``HOT`` fingerprints a task walks from fingerprint to fingerprint and passes on a spanning tree
of the links, not all pairs. Larger files are not gathered: their fingerprints meet over midpoints. Two fingerprints
at distance three have a value that is one bit from the first and two from the second, so filing each under all values
within two bits and linking each to the least one within a single bit of the value finds every link, at a cost in
proportion to the number of fingerprints.

Odd input: a null text is empty and has fingerprint zero, linked like any other. Rows with a null id are linked, too,
but no component is named by them; a component of such rows alone has a null name. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobtally.llm.graph import components
from jobtally.llm.tables import apart, inner, materialise

SHINGLE = 3
BITS = 3
SEED = 42
WIDTHS = (11, 11, 11, 11, 10, 10)
HOT = 1 << 15
PART = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = list(map(b" ".join, zip(*[found[i:] for i in range(shingle)]))) if len(found) >= shingle else [b" ".join(found)]
    digest, set_in = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), PART):
        h = np.array([digest(s, SEED) for s in shingles[at : at + PART]], np.uint64)
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_in > len(shingles), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found.view(np.int64))], ["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, fp) for each row; ``digest`` tells texts apart."""
    picked = inner(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return picked.mapInArrow(lambda batches: _fingerprints(batches, shingle), "doc_id long, digest long, fp long")


def file_keys(fp: str = "fp") -> Column:
    """The 20 files of a fingerprint: the choice of blocks and their bits."""
    starts = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    keys = []
    for number, chosen in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - BITS)):
        key = F.lit(number).cast("long")
        for block in chosen:
            bits = F.shiftrightunsigned(F.col(fp), starts[block]).bitwiseAND(F.lit((1 << WIDTHS[block]) - 1).cast("long"))
            key = F.shiftleft(key, WIDTHS[block]).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def _tree(f: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all linked values of ``f``, each found from the one before it."""
    links, rest = [], f
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found = rest[near]
                links.extend((int(at), int(x)) for x in found)
                front.extend(found)
                rest = rest[~near]
    return links


def _links(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Links within runs of equal keys."""
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(keys)))
    two = new[size == 2]
    two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
    out = [np.stack([fps[two], fps[two + 1]], axis=1)]
    for at, n in zip(new[size > 2], size[size > 2]):
        if tree := _tree(fps[at : at + n], bits):
            out.append(np.array(tree, np.uint64))
    return np.concatenate(out)


def _match(batches: Iterator[pa.RecordBatch], bits: int, hot: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by file: links as (a, b), and (a, null) for fingerprints of files beyond ``hot``."""

    def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(np.ascontiguousarray(b).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), second], ["a", "b"])

    held_k, held_f, beyond = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        k = np.concatenate([held_k, batch.column("key").to_numpy()])
        f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
        if beyond is not None and len(k):
            n = int(np.searchsorted(k, beyond, side="right"))
            if n:
                yield rows(f[:n], None)
                k, f = k[n:], f[n:]
        if not len(k):
            held_k, held_f = k, f
            continue
        last = int(np.searchsorted(k, k[-1]))
        links = _links(k[:last], f[:last], bits)
        if len(links):
            yield rows(links[:, 0], links[:, 1])
        held_k, held_f = k[last:], f[last:]
        if len(held_k) > hot:
            yield rows(held_f, None)
            beyond, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
    links = _links(held_k, held_f, bits)
    if len(links):
        yield rows(links[:, 0], links[:, 1])


def _midpoints(crowd: DataFrame) -> DataFrame:
    """Links among fingerprints of overlarge files, by values within two bits of each."""
    one = [0, *[1 << i for i in range(64)]]
    two = [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in one + two]
    masks = F.array(*[F.lit(m).cast("long") for m in signed])
    filed = crowd.select("fp", F.posexplode(masks).alias("place", "mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), (F.col("place") < len(one)).alias("near"))
    hubs = filed.where("near").groupBy("value").agg(F.min("fp").alias("hub"))
    return filed.join(hubs, "value").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(found: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that connect all fingerprints within three bits of each other."""
    filed = found.select("fp").distinct().select("fp", F.explode(file_keys()).alias("key"))
    sorted_rows = filed.repartition("key").sortWithinPartitions("key")
    matched = materialise(sorted_rows.mapInArrow(lambda batches: _match(batches, BITS, hot), "a long, b long"), "matched")
    return matched.where("b is not null").unionByName(_midpoints(matched.where("b is null").select(F.col("a").alias("fp")).distinct()))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", hot: int = HOT) -> DataFrame:
    """(doc_id, digest, fp, hub, component_id) for each row; the id is the smallest one reachable over links.

    ``hub`` is the least fingerprint of the component, which names it also where no row has an id.
    """
    found = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    stars = components(links(found, hot))
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(stars.select(F.col("a").alias("fp"), F.col("b").alias("hub")), "fp", "left").select("fp", "least", F.coalesce("hub", "fp").alias("hub"))
    names = named.groupBy("hub").agg(F.min("least").alias("component_id"))
    return found.join(named.select("fp", "hub").join(names, "hub"), "fp").select("doc_id", "digest", "fp", "hub", "component_id")


@apart
def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The row of smallest id of each component, with all its columns."""
    found = near_duplicates(docs, id_col, text_col)
    # Rows without an id come last.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = found.groupBy("hub").agg(F.min(order).alias("first")).select("first.*")
    winners = first.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("no_id").alias("__no_id"), F.col("digest").alias("__digest"))
    source = F.col(f"`{id_col}`").cast("long")
    keyed = docs.withColumns({"__id": F.coalesce(source, F.lit(0).cast("long")), "__no_id": source.isNull(), "__digest": F.xxhash64(f"`{text_col}`")})
    keys = ["__id", "__no_id", "__digest"]
    return keyed.join(winners, keys).dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
