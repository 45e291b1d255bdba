"""Byte-level BPE by DuckDB recursive queries, one database per Python worker, fed by each partition.

A text is split by the tokenizer's pattern. Different pieces go to the database in groups: one row per piece and
position, first with the ids of single bytes. A recursive query joins neighbouring rows with the merge table and
contracts each piece's leftmost pair of least rank, until no pair is left that the table holds. An ordered aggregation
of the tokens' bytes decodes. The merge table lists every way to split a token into two tokens.

Pieces are kept over batches in a bounded memory that is emptied when full. Pieces beyond ``LONG`` bytes, where a
contraction per step would take time with the square of the length, follow the same rule with a heap of pairs.
Odd input: a null text is empty and has no ids; ids are passed through, null or repeated.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtally.llm import words as W
from jobtally.llm.tables import inner

LONG = 128
GROUP = 10_000
REMEMBERED = 1_000_000  # some 300 MB of a worker
SLICE = 8_000_000

# A row's id holds piece and position (the low bits); a pair's key holds its rank and position, so that the least key of
# a piece is its leftmost pair of least rank.
CODE = """
WITH RECURSIVE state(id, token, size, live) AS (
    SELECT id, token, 1::BIGINT, true FROM bytes_of
  UNION ALL
    (WITH pairs AS (
        SELECT s.id, n.id AS next, s.size + n.size AS size, m.rank << 16 | (s.id & 65535) AS key
        FROM state s JOIN state n ON n.id = s.id + s.size JOIN merges m ON m.pair = (s.token << 32 | n.token)
        WHERE s.live AND n.live),
     best AS (
        SELECT id >> 16 AS piece, min(key) AS key, arg_min(next, key) AS next, arg_min(size, key) AS size
        FROM pairs GROUP BY piece)
     SELECT s.id,
            CASE WHEN s.id & 65535 = b.key & 65535 THEN b.key >> 16 ELSE s.token END,
            CASE WHEN s.id & 65535 = b.key & 65535 THEN b.size ELSE s.size END,
            b.piece IS NOT NULL
     FROM state s LEFT JOIN best b ON b.piece = s.id >> 16
     WHERE s.live AND (b.next IS NULL OR s.id <> b.next))
)
SELECT s.id >> 16 AS piece, string_agg(s.token::VARCHAR, ',' ORDER BY s.id) AS ids, string_agg(hex(t.bytes), '' ORDER BY s.id) AS decoded
FROM state s JOIN tokens t ON t.id = s.token WHERE NOT s.live GROUP BY piece ORDER BY piece
"""

DECODE = """
SELECT piece, string_agg(hex(t.bytes), '' ORDER BY pos) AS decoded
FROM (SELECT piece, unnest(string_split(ids, ','))::INTEGER AS token, generate_subscripts(string_split(ids, ','), 1) AS pos FROM coded) c
JOIN tokens t ON t.id = c.token GROUP BY piece ORDER BY piece
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(first, second, rank): every split of a token into two tokens."""
    return [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


class Bpe:
    """Encodes and decodes pieces by queries over a vocabulary."""

    def __init__(self, path: str):
        import duckdb

        self.ranks = load_ranks(path)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": "", "preserve_insertion_order": False})
        rows = np.array(merge_rows(self.ranks), np.int64)
        merges = pa.table({"pair": rows[:, 0] << 32 | rows[:, 1], "rank": rows[:, 2]})
        tokens = pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "bytes": pa.array(list(self.ranks), pa.binary())})
        for name, table in (("merges", merges), ("tokens", tokens)):
            self.db.register("loaded", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
            self.db.unregister("loaded")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def long_ids(self, piece: bytes) -> list[int]:
        """The rule of ``CODE`` for one long piece."""
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))

        def pair(i: int) -> tuple[int, int, bytes] | None:
            j = after[i]
            if i < 0 or j >= len(parts):
                return None
            both = parts[i] + parts[j]
            return (self.ranks[both], i, both) if both in self.ranks else None

        heap = [p for i in range(len(parts)) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # a neighbour has changed since
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [self.ranks[p] for p in parts if p is not None]

    def _code(self, pieces: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Ids of pieces, joined by commas, and the bytes of their tokens in order."""
        ids: list[bytes] = [b""] * len(pieces)
        decoded: list[bytes] = [b""] * len(pieces)
        rest, known = [], []
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                ids[i] = b"%d" % self.ranks[piece]
                known.append(i)
            elif len(piece) > LONG:
                ids[i] = ",".join(map(str, self.long_ids(piece))).encode()
                known.append(i)
            else:
                rest.append(i)
        for at in range(0, len(rest), GROUP):
            part = rest[at : at + GROUP]
            sizes = np.array([len(pieces[i]) for i in part])
            number = np.repeat(np.arange(len(part)), sizes)
            pos = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = self.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            self.db.register("bytes_of", pa.table({"id": number << 16 | pos, "token": token}))
            found = self.db.sql(CODE).to_arrow_table()
            for i, own, back in zip(part, found["ids"].to_pylist(), found["decoded"].to_pylist(), strict=True):
                ids[i], decoded[i] = own.encode(), bytes.fromhex(back)
        for at in range(0, len(known), GROUP):
            part = known[at : at + GROUP]
            self.db.register("coded", pa.table({"piece": pa.array(range(len(part)), pa.int32()), "ids": [ids[i].decode() for i in part]}))
            for i, back in zip(part, self.db.sql(DECODE).to_arrow_table()["decoded"].to_pylist(), strict=True):
                decoded[i] = bytes.fromhex(back)
        return ids, decoded

    def learn(self, pieces: set[str]) -> None:
        """Make ``known`` hold the ids and bytes of the pieces."""
        new = list(pieces - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(pieces)
        if new:
            self.known.update(zip(new, zip(*self._code([p.encode() for p in new]))))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(text: str, path: str, pattern: str) -> tuple[bytes, bytes]:
    """Ids of a text, joined by commas, and the bytes they decode to."""
    pieces = splitter(pattern).findall(text)
    own = bpe(path)
    own.learn(set(pieces))
    ids, decoded = zip(*map(own.known.__getitem__, pieces)) if pieces else ((), ())
    return b",".join(ids), b"".join(decoded)


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str, full: bool) -> Iterator[pa.RecordBatch]:
    own, split = bpe(path), splitter(pattern)
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("text"), SLICE):
            pieces = [split.findall(t.as_py() or "") for t in rows.column("text")]
            own.learn(set().union(*pieces))
            counts, ids, decoded = [], [], []
            for found in pieces:
                both = zip(*map(own.known.__getitem__, found)) if found else ((), ())
                coded, back = (sign.join(x) for sign, x in zip((b",", b""), both))
                counts.append(coded.count(b",") + bool(found))
                ids.append(list(map(int, coded.split(b","))) if full and found else [] if full else hashlib.sha256(coded).hexdigest())
                decoded.append(back if full else hashlib.sha256(back).hexdigest())
            names = ["doc_id", "n_tokens", "ids", "decoded"]
            kinds = (pa.list_(pa.int32()), pa.binary()) if full else (pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, kinds[0]), pa.array(decoded, kinds[1])], names)


def tokens(docs: DataFrame, path: str, pattern: str, full: bool = True, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row; without ``full``, SHA-256 of the decimal ids and of the bytes."""
    picked = inner(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, " + ("ids array<int>, decoded binary" if full else "ids string, decoded string")
    return picked.mapInArrow(lambda batches: _digests(batches, path, pattern, full), schema)
