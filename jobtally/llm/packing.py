"""Packing token sequences: shortest pack first over the histogram of piece lengths.

A document's ids are those of a tokenizer file, then an end id. Documents are cut into whole sequences of ``size`` ids
and a rest. The histogram of piece lengths, at most ``size`` numbers, is all that the driver sees: lengths are placed
longest first, each into the packs with most room left, updating how many packs follow each pattern. Patterns then
return to the pieces by rank: pieces are numbered within their length, and a slot table, bounded by ``size`` and not by
the data, says which numbers of a length go to which sequence and offset.

A piece's number comes from counts by length and salt, so a length that most documents share is numbered in parallel.
Words are lower-cased (A-Z, as the tokenizer does), cut where letters and punctuation meet, encoded once and kept over
slices; the tokenizer drops white space and splits there, too, so the ids of a text are those of its words. Words of
a-z alone go to the tokenizer's model, others through all of its steps. Strings of special tokens are ordinary text.

Odd input: a null text is empty and has the end id alone; null and repeated ids are packed row by row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from jobtally.llm import words as W
from jobtally.llm.tables import inner, materialise

SIZE = 2048
END = 1
SLICE = 8_000_000
REMEMBERED = 400_000
_GAP = np.zeros(256, bool)
_GAP[[32, 10]] = True
# Where these meet, the tokenizer's pattern always splits; an apostrophe is neither, as it may start a suffix.
_KIND = np.zeros(256, np.int8)
_KIND[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass
class Encoder:
    """Ids of words, kept in a bounded memory that is emptied when full."""

    path: str
    known: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # A mark of one id between words, to encode many of them in a call.
        marks = ((m, self.tokenizer.encode(m, add_special_tokens=False).ids) for m in map(chr, range(0x3041, 0x3097)))
        self.mark, ids = next((m, i) for m, i in marks if len(i) == 1)
        self.mark_id = ids[0]

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def many(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        ids = np.array(self.ids(f" {self.mark} ".join(texts)), np.uint32)
        at = np.flatnonzero(ids == self.mark_id)
        if len(at) != len(texts) - 1:  # a word holds the mark
            return [np.array(self.ids(t), np.uint32).tobytes() for t in texts]
        first, *rest = np.split(ids, at)
        return [first.tobytes(), *[x[1:].tobytes() for x in rest]]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[bytes]:
        """Ids of different words, as little-endian 32-bit numbers."""
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(range(len(keys)))
        raw, others = data.tobytes(), []
        for i in new:
            word = raw[starts[i] : ends[i]].lower()
            if word.isalpha():  # bytes: a-z only
                self.known[keys[i]] = pack(f"<{len(ids := [t.id for t in self.model.tokenize(word.decode())])}I", *ids)
            else:
                others.append((keys[i], word.decode()))
        for at in range(0, len(others), 5000):
            part = others[at : at + 5000]
            self.known.update(zip([k for k, _ in part], self.many([w for _, w in part])))
        return [self.known[k] for k in keys]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted and once each."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def token_ids(texts: pa.Array, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, each text's followed by ``end``, and where each text's ids start."""
    data, offsets = W.raw(texts)
    starts, ends = W.spans(data, offsets, _GAP)
    kind = _KIND[data]
    meet = np.flatnonzero(kind[:-1] * kind[1:] == 2) + 1
    starts, ends = _joined(starts, meet), _joined(ends, meet)
    hashes, which, inverse = np.unique(W.span_hashes(data, starts, ends, lower=True), return_index=True, return_inverse=True)
    coded = encoder(path).words(data, starts[which], ends[which], hashes)
    coded.append(np.array([end], np.uint32).tobytes())
    size = np.array([len(c) // 4 for c in coded], np.int64)
    flat = np.frombuffer(b"".join(coded), np.uint32)
    begin = np.cumsum(size) - size
    first = np.searchsorted(starts, offsets)
    order = np.insert(inverse, first[1:], len(coded) - 1)
    counts = size[order]
    before = np.cumsum(counts) - counts
    ids = flat[np.repeat(begin[order] - before, counts) + np.arange(int(counts.sum()))]
    edge = np.append(before, len(ids))[first + np.arange(len(first))]
    return ids, edge


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("text"), SLICE):
            ids, edge = token_ids(rows.column("text"), path, end)
            total = np.diff(edge)
            pieces = -(-total // size)
            owner = np.repeat(np.arange(len(total)), pieces)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * size
            length = np.minimum(size, total[owner] - start)
            view = memoryview(ids.tobytes())
            at = (edge[owner] + start) * 4
            crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(owner)), *[pa.array(np.asarray(x, np.int64)) for x in (start, length, crc, total[owner])]],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )


def cut(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece of each document."""
    picked = inner(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInArrow(lambda batches: _pieces(batches, path, size, end), PIECES)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Shortest pack first: (lengths of a pack, longest first; number of such packs)."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_rooms = [0] * (size + 1)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # Packs with most room are taken first; those filled by this length may take it again.
        for space in range(size, length - 1, -1):
            while left and open_rooms[space]:
                lengths, count = room[space].pop()
                open_rooms[space] -= 1
                used = min(left, count)
                if used < count:
                    room[space].append((lengths, count - used))
                    open_rooms[space] += 1
                room.setdefault(space - length, []).append(((*lengths, length), used))
                open_rooms[space - length] += 1
                left -= used
            if not left:
                break
        while left:
            # New packs take as many of the length as fit.
            fit = size // length
            packs, rest = divmod(left, fit)
            n, each = (packs, fit) if packs else (1, rest)
            room.setdefault(size - each * length, []).append(((length,) * each, n))
            open_rooms[size - each * length] += 1
            left -= n * each
    return [pack for packs in room.values() for pack in packs]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: the first number, how often in a pack, the first sequence and the offset."""
    rows, taken, sequence = [], {}, 0
    for lengths, count in packs:
        offset = 0
        for length in dict.fromkeys(lengths):
            times = lengths.count(length)
            rows.append((length, taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + count * times
            offset += times * length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": table[:, 0] << 48 | table[:, 1], "times": table[:, 2], "sequence": table[:, 3], "offset": table[:, 4]}


def _place(batches: Iterator[pa.RecordBatch], table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        key = length << 48 | rank
        at = np.searchsorted(table["key"], key, side="right") - 1
        turn, again = np.divmod(key - table["key"][at], table["times"][at])
        out = [pa.array(table["sequence"][at] + turn), pa.array(table["offset"][at] + again * length)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [*batch.schema.names[:-1], "sequence_id", "offset"])


def numbered(pieces: DataFrame) -> DataFrame:
    """Each piece with its number within its length, from 0."""
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(within) - 1)
    return ranked.join(firsts, ["length", "salt"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("within")).alias("rank"))


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    pieces = materialise(cut(docs, path, size, end, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    table = slots(patterns(histogram, size))
    return numbered(pieces).mapInArrow(lambda batches: _place(batches, table), f"{PIECES}, sequence_id long, offset long")
