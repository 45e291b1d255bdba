"""Exact top-k search by BM25: an inverted index per shard, block-max WAND, an exact merge.

Score of a document: the sum over the query's different words (A-Z lower-cased) that it holds of idf * tf (k1 + 1) / (tf +
k1 (1 - b + b length / mean length)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean are those of all rows.

1. Each shard, ``SHARD`` bytes of text, is one row of a written table: sorted word hashes and postings. Documents of a
   shard are ordered by their most frequent common word, so that blocks of ``BLOCK`` documents are alike.
2. Document frequencies of the query words are summed in hash buckets over all shards and go back to the queries.
3. Queries are taken in blocks of at most ``TERMS`` words, a proven bound on what is broadcast. For a query, each
   document has an upper bound: for common words the largest contribution in its block, for others the contributions
   there are. The common words of documents that may reach the threshold are summed as a product of matrices, in single
   precision; those that do reach it, or the k best, are scored exactly.
4. A first round over a fixed share of the shards gives each query a threshold, a lower bound of its k-th score, which
   prunes the other shards. The shards' lists are merged exactly: by score, then smaller id.

Odd input: null and blank texts are indexed and found by no query, a blank query finds nothing; null ids are indexed and
come last among equal scores; repeated rows are found once each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from jobtally.llm import words as W
from jobtally.llm.tables import buckets, inner, materialise

K1, B = 1.2, 0.75
SHARD, SLICE = 16_000_000, 4_000_000
BLOCK, COMMON = 32, 20  # documents in a block; a word is common in a shard if so great a part of its documents holds it
TABLE, BATCH = 1 << 22, 1 << 20  # entries of a shard's table of common words, and of a batch of queries
CLOSE, FEW = 1e-5, 64  # documents that may reach the floor, to be scored one by one
TERMS = 4_000_000
SEED_SHARE = 16
NO_ID = (1 << 63) - 1
SHARDS = "shard long, documents long, words long, doc_ids binary, lengths binary, vocab binary, offsets binary, docs binary, tfs binary"
FOUND = "query_id long, query long, doc_id long, score double"


def _postings(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, times), in order of texts."""
    owner = w.owners()
    order = np.lexsort((w.hashes, owner))
    owner, h = owner[order], w.hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    return owner[new], h[new], np.diff(np.append(new, len(h)))


def _shard(number: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    base = np.cumsum([0, *[len(p[0]) for p in parts]])
    ids, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner = np.concatenate([p[2] + b for p, b in zip(parts, base)])
    h, tf = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
    vocab, word, df = np.unique(h, return_inverse=True, return_counts=True)
    # Order documents by their most frequent word among the shard's commonest.
    common = np.argsort(-df, kind="stable")[:64]
    rank = np.full(len(vocab), 64)
    rank[common] = np.arange(len(common))
    best = np.lexsort((rank[word], -np.where(rank[word] < 64, tf, 0), owner))
    first = np.flatnonzero(np.concatenate([[True], owner[best][1:] != owner[best][:-1]])) if len(best) else best
    topic = np.full(len(ids), 65)
    topic[owner[best][first]] = rank[word[best][first]]
    order = np.lexsort((lengths, topic))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, lengths, owner = ids[order], lengths[order], place[owner]
    by_word = np.lexsort((owner, word))
    offsets = np.concatenate([[0], np.cumsum(df)])
    blobs = [ids.astype(np.int64), lengths.astype(np.int32), vocab, offsets.astype(np.int64), owner[by_word].astype(np.int32), tf[by_word].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)]), pa.array([int(lengths.sum())]), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], [c.split()[0] for c in SHARDS.split(", ")])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, parts, held = 0, [], 0
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("text"), SLICE):
            w = W.words(rows.column("text"), lower=True)
            owner, h, tf = _postings(w)
            parts.append((np.asarray(rows.column("doc_id"), np.int64), w.counts, owner, h, tf))
            held += len(w.data)
            if held >= SHARD:
                yield _shard(TaskContext.get().partitionId() * (1 << 32) + part, parts)
                part, parts, held = part + 1, [], 0
    if parts:
        yield _shard(TaskContext.get().partitionId() * (1 << 32) + part, parts)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of queries: their ids and different words."""
    part = 0
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("text"), SLICE // 4):
            w = W.words(rows.column("text"), lower=True)
            owner, h, _ = _postings(w)
            number, part = TaskContext.get().partitionId() * (1 << 32) + part, part + 1
            edge = np.searchsorted(owner, np.arange(rows.num_rows + 1))
            blobs = [np.asarray(rows.column("doc_id"), np.int64), edge.astype(np.int64), h]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(h)]), *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], ["chunk", "n", "ids", "edges", "terms"])


def _deal(batches: Iterator[pa.RecordBatch], n: int, asked: bool) -> Iterator[pa.RecordBatch]:
    """Words by hash bucket with their document counts, or those that queries ask for."""
    for batch in batches:
        for row in batch.to_pylist():
            h = np.frombuffer(row["terms"] if asked else row["vocab"], np.uint64)
            counts = np.zeros(len(h), np.int32) if asked else np.diff(np.frombuffer(row["offsets"], np.int64)).astype(np.int32)
            if asked:
                h, counts = np.unique(h), counts[:0]
            where = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
            edge = np.searchsorted(where, np.arange(n + 1))
            full = np.flatnonzero(np.diff(edge))
            cut = [slice(edge[i], edge[i + 1]) for i in full]
            source = row["chunk"] if asked else -1
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([source] * len(full), pa.int64()), pa.array([h[c].tobytes() for c in cut], pa.binary()), pa.array([counts[c].tobytes() for c in cut], pa.binary())], ["bucket", "chunk", "words", "counts"])


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """The document frequencies of a bucket's query words, for each chunk of queries."""
    given, asked = rows[rows["chunk"] < 0], rows[rows["chunk"] >= 0]
    h, counts = np.frombuffer(b"".join(given["words"]), np.uint64), np.frombuffer(b"".join(given["counts"]), np.int32)
    words, inverse = np.unique(h, return_inverse=True)
    total = np.bincount(inverse, counts, len(words)).astype(np.int64)
    found = [total[np.searchsorted(words, np.frombuffer(b, np.uint64))].tobytes() for b in asked["words"]]
    return pd.DataFrame({"chunk": asked["chunk"], "words": asked["words"], "df": found})


class Index:
    """One shard, ready to be searched."""

    def __init__(self, row: dict, mean: float):
        self.ids, lengths = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["lengths"], np.int32)
        self.vocab, self.offsets = np.frombuffer(row["vocab"], np.uint64), np.frombuffer(row["offsets"], np.int64)
        self.docs, tf = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int32)
        self.part = (K1 * (1 - B) + K1 * B / max(mean, 1e-9) * lengths)[self.docs]
        self.part += tf
        np.divide(tf * (K1 + 1), self.part, out=self.part)
        self.n, self.blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        sizes, room = np.diff(self.offsets), self.blocks * BLOCK
        # Common words are columns of a table of all documents, with their largest part in each block.
        common = np.flatnonzero(sizes * COMMON >= max(self.n, 1))
        common = common[np.argsort(-sizes[common], kind="stable")][: TABLE // max(room, 1)]
        self.column = np.full(len(sizes), -1)
        self.column[common] = np.arange(len(common))
        self.table = np.zeros((room, len(common)))
        at = self._ranges(self.offsets[common], sizes[common])
        self.table[self.docs[at], np.repeat(np.arange(len(common)), sizes[common])] = self.part[at]
        self.single = self.table.astype(np.float32)
        self.most = self.single.reshape(self.blocks, BLOCK, len(common)).max(axis=1)
        self.places = np.arange(1 << 12)

    @staticmethod
    def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    def _rest(self, start: np.ndarray, size: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """The exact sums of the words with short lists, by document."""
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        if total > len(self.places):
            self.places = np.arange(2 * total)
        at = np.repeat(start - ends + size, size)
        at += self.places[:total]
        each = np.repeat(idf, size)
        each *= self.part.take(at, mode="clip")
        return np.bincount(self.docs.take(at, mode="clip"), each, self.blocks * BLOCK)

    def tops(self, edges: np.ndarray, words: np.ndarray, idf: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, documents and scores of the k best that reach its floor; words: places in the vocabulary."""
        step = min(max(BATCH // max(*self.table.shape, 1), 1), 256)
        for first in range(0, len(floors), step):
            edge = edges[first : first + step + 1]
            own = slice(edge[0], edge[-1])
            yield from self._tops(edge - edge[0], words[own], idf[own], k, floors[first : first + step])

    def _tops(self, edges: np.ndarray, words: np.ndarray, idf: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        count = len(floors)
        query, column = np.repeat(np.arange(count), np.diff(edges)), self.column[words]
        common, short = column >= 0, np.flatnonzero(column < 0)
        weights = np.zeros((count, self.table.shape[1]))
        weights[query[common], column[common]] = idf[common]
        single = weights.astype(np.float32)
        bounds = single @ self.most.T
        start, edge = self.offsets[words[short]], np.searchsorted(query[short], np.arange(count + 1))
        size, idf = self.offsets[words[short] + 1] - start, idf[short]
        # Single precision and sums in another order differ in the last digits; what is this close is still scored.
        low = floors * (1 - CLOSE)
        found, many = [None] * count, []
        for i in range(count):
            own = slice(edge[i], edge[i + 1])
            rest = self._rest(start[own], size[own], idf[own])
            docs = np.flatnonzero((rest.reshape(-1, BLOCK) + bounds[i][:, None]).ravel()[: self.n] >= max(low[i], np.finfo(np.float64).tiny))
            if len(docs) > FEW:
                many.append((i, rest))
            else:
                found[i] = self._best(docs, rest, weights[i], k, floors[i])
        sums = single[[i for i, _ in many]] @ self.single.T
        for (i, rest), reached in zip(many, sums):
            reached = reached + rest
            docs = np.flatnonzero(reached >= max(low[i], np.finfo(np.float64).tiny))
            if len(docs) > k:
                docs = docs[reached[docs] >= np.partition(reached[docs], -k)[-k] * (1 - 2 * CLOSE)]
            found[i] = self._best(docs, rest, weights[i], k, floors[i])
        return found

    def _best(self, docs: np.ndarray, rest: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        if not len(docs):
            return np.zeros(0, np.int64), np.zeros(0)
        scores = np.round(self.table[docs] @ weights + rest[docs], 9)  # copies in other shards are summed in another order
        best = np.lexsort((self.ids[docs], -scores))[:k]
        docs, scores = docs[best], scores[best]
        keep = (scores > 0) & (scores * (1 + 1e-9) >= floor)
        return self.ids[docs[keep]], scores[keep]

    def top(self, words: np.ndarray, idf: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The same for one query."""
        return next(self.tops(np.array([0, len(words)]), words, idf, k, np.array([floor])))


def _search(batches: Iterator[pa.RecordBatch], shared, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    ids, numbers, edges, known, terms, idf, floors = shared.value
    for batch in batches:
        for i in range(batch.num_rows):
            index = Index(batch.slice(i, 1).to_pylist()[0], mean)
            if not len(index.vocab):
                continue
            place = np.minimum(np.searchsorted(index.vocab, known), len(index.vocab) - 1)
            place = np.where(index.vocab[place] == known, place, -1)[terms]
            held = np.flatnonzero(place >= 0)
            edge = np.searchsorted(held, edges)
            out = [(np.full(len(docs), ids[q]), np.full(len(docs), numbers[q]), docs, scores) for q, (docs, scores) in enumerate(index.tops(edge, place[held], idf[terms[held]], k, floors))]
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query", "doc_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col="doc_id", text_col="text", terms_at_once: int = TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of ``docs`` for each row of ``queries`` (same columns)."""
    spark = docs.sparkSession
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    own = inner(docs, doc_id=id_col, text=text_col).select(number("doc_id").alias("doc_id"), "text")
    asked = inner(queries, doc_id=id_col, text=text_col).select(number("doc_id").alias("doc_id"), "text")
    shards = materialise(own.mapInArrow(_index, SHARDS), "shards")
    chunks = materialise(asked.mapInArrow(_ask, "chunk long, n long, ids binary, edges binary, terms binary"), "queries")
    total = shards.agg(F.sum("documents"), F.sum("words")).first()
    n_docs, mean = total[0] or 0, (total[1] or 0) / max(total[0] or 0, 1)
    n = buckets(spark)
    dealt = [part.mapInArrow(lambda batches, a=a: _deal(batches, n, a), "bucket int, chunk long, words binary, counts binary") for part, a in ((shards.select("vocab", "offsets"), False), (chunks.select("chunk", "terms"), True))]
    frequencies = materialise(dealt[0].unionByName(dealt[1]).groupBy("bucket").applyInPandas(_frequencies, "chunk long, words binary, df binary"), "frequencies")
    blocks, size = [[]], 0
    for row in chunks.select("chunk", "n").orderBy("chunk").toLocalIterator():
        if size + row["n"] > terms_at_once and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(row["chunk"])
        size += row["n"]
    first, found = 0, []
    # A fixed share of the shards, the same for every block of queries.
    seeds = F.pmod(F.xxhash64("shard"), F.lit(SEED_SHARE)) == 0
    for block in blocks:
        parts = sorted(chunks.where(F.col("chunk").isin(block)).collect(), key=lambda r: r["chunk"])
        of_chunk = defaultdict(list)
        for row in frequencies.where(F.col("chunk").isin(block)).collect():
            of_chunk[row["chunk"]].append(row)
        ids, edges, terms, found_df = [], [np.zeros(1, np.int64)], [], []
        for part in parts:
            known, df = (np.frombuffer(b"".join(r[c] for r in of_chunk[part["chunk"]]), kind) for c, kind in (("words", np.uint64), ("df", np.int64)))
            order = np.argsort(known)
            h, edge = np.frombuffer(part["terms"], np.uint64), np.frombuffer(part["edges"], np.int64)
            ids.append(np.frombuffer(part["ids"], np.int64))
            edges.append(edge[1:] + edges[-1][-1])
            terms.append(h)
            found_df.append(df[order][np.searchsorted(known[order], h)] if len(h) else np.zeros(0))
        if not parts:
            continue
        ids, edges, df = np.concatenate(ids), np.concatenate(edges), np.concatenate(found_df)
        # Each word is looked up once in a shard, however many queries hold it.
        known, at, terms = np.unique(np.concatenate(terms), return_index=True, return_inverse=True)
        idf, terms = np.log1p((n_docs - df[at] + 0.5) / (df[at] + 0.5)), terms.astype(np.int32)
        numbers = first + np.arange(len(ids))
        first += len(ids)

        def searched(these: DataFrame, floors: np.ndarray) -> DataFrame:
            shared = spark.sparkContext.broadcast((ids, numbers, edges, known, terms, idf, floors))
            return materialise(_best(these.mapInArrow(lambda batches: _search(batches, shared, mean, k), FOUND), k), "found")

        seeded = searched(shards.where(seeds), np.zeros(len(ids)))
        floors = np.zeros(len(ids))
        for row in seeded.where(F.col("rank") == k).select("query", "score").collect():
            floors[row["query"] - numbers[0]] = row["score"]
        found += [seeded.drop("rank"), searched(shards.where(~seeds), floors).drop("rank")]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return _best(merged, k).select(real("query_id"), "rank", real("doc_id"), "score")
