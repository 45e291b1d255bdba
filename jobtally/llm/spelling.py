"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form they stem from.

Words are marked with a terminator and rotated at every place. A rotation that ends in the edited character shares the
prefix before it with every word that has another character there, and equals a whole rotation of the word that has
none. So each word gives two kinds of keys, all its rotations, whole and less their last character; rows sorted by key
form groups of words that are near each other, and one scan of a group counts and ranks neighbours without making
pairs. A group holds a word per character of the alphabet and one that lacks it, 91 at most.

A character that repeats can be deleted at several places with the same result; only the first place of a run of equal
characters counts, so every near pair meets in exactly one group.

Odd input: a null text has no words; a null id counts as empty text. Rows that repeat an id and a text count again. Very
long words are compared by 124-bit prints of their rotations, so a word needs memory in proportion to its length. Ties
go to the word that is smaller in code-point order. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from jobtally.llm.tables import inner, materialise
from jobtally.llm.words import slices

LEAST = 7  # code points of a word
OFTEN = 2  # occurrences
FACTOR = 10  # a form is so many times as frequent
DAMAGE = 31  # of so many runs one loses a character
PLAIN = 64  # code points up to which rotations are kept as text
END = "$"  # no letter
HELD = 200_000  # words a task counts before it passes them on
STEP = 8_000_000  # bytes of text looked at together

# Primes for prints of long rotations, with a base for each.
PRIMES = ((2147483647, 131071), (2147483629, 524287), (2147483587, 8388593), (2147483579, 99999989))


def _counting(least: int, damage: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def full():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 1, STEP):
                ids = part.column(0).to_pylist()
                for doc_id, text in zip(ids, pc.ascii_lower(pc.fill_null(part.column(1), "")).to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(run.findall(text)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        found[word] += n
                if len(found) > HELD:
                    yield full()
                    found.clear()
        if found:
            yield full()

    return count


def word_counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN, damage: int = DAMAGE) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``least`` code points at least that occur ``often`` times or more.

    One in ``damage`` runs, by the crc32 of id and run, loses the character its crc32 points at.
    """
    texts = inner(docs, doc_id="doc_id", text="text")
    return texts.mapInArrow(_counting(least, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    at = 1
    while at < n:
        more = min(at, n - at)
        out[at : at + more] = out[:more] * pow(base, at, prime) % prime
        at += more
    return out


def _prints(word: str) -> tuple[list[str], list[str]]:
    """Prints of all whole rotations (by the place they start at) and of rotations less their last character (by its place).

    The print of y$x is a polynomial in a base, modulo several primes, from sums over the marked word.
    """
    codes = np.array([*map(ord, word), ord(END)], np.int64)
    n = len(word)
    whole, less = [], []
    for prime, base in PRIMES:
        power, inverse = _powers(base, n + 2, prime), _powers(pow(base, -1, prime), n + 2, prime)
        sums = np.concatenate([[0], np.cumsum(codes * power[: n + 1] % prime)]) % prime  # of the marked word before each place
        start = np.arange(n + 1)
        head = (sums[n + 1] - sums[start]) % prime * inverse[start] % prime
        whole.append((head + sums[start] * power[n + 1 - start]) % prime)
        head = (sums[n + 1] - sums[start[:n] + 1]) % prime * inverse[start[:n] + 1] % prime
        less.append((head + sums[start[:n]] * power[n - start[:n]]) % prime)
    named = lambda parts, size: [f"#{size}:" + "".join(f"{v:08x}" for v in row) for row in np.column_stack(parts).tolist()]
    return named(whole, n + 1), named(less, n)


def rotations(word: str) -> list[tuple[str, int]]:
    """Keys of a word with their kind: 2 a whole rotation, 1 less its last character, the first of a run of equal ones, 0 less another."""
    n, marked = len(word), word + END
    whole, less = _prints(word) if n >= PLAIN else (None, None)
    if whole is None:
        whole = [marked[i:] + marked[:i] for i in range(n + 1)]
    if less is None or n == PLAIN:
        less = [marked[i + 1 :] + marked[:i] for i in range(n)]
    kinds = [int(i == 0 or word[i] != word[i - 1]) for i in range(n)]
    return [(key, 2) for key in whole] + list(zip(less, kinds, strict=True))


def _rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def full():
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(kinds, pa.int32())],
            ["key", "id", "n", "kind"],
        )

    keys, ids, counts, kinds = [], [], [], []
    for batch in batches:
        for word_id, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for key, kind in rotations(word):
                keys.append(key), ids.append(word_id), counts.append(n), kinds.append(kind)
            if len(keys) > 100_000:
                yield full()
                keys, ids, counts, kinds = [], [], [], []
    if keys:
        yield full()


def neighbours(numbered: DataFrame) -> DataFrame:
    """(id, n_near, best) for each of the rows (id, word, n) that has near words; ``best`` is the least (-n, id) of them.

    Ids follow the order of words.
    """
    keyed = numbered.select("id", "word", "n").mapInArrow(_rotated, "key string, id long, n long, kind int")
    entry = F.struct((-F.col("n")).alias("loss"), "id")
    group = Window.partitionBy("key")
    ranked = group.orderBy(F.col("kind") == 2, F.desc("n"), "id")  # the word without the character comes last
    less = F.col("kind") < 2
    scanned = keyed.select(
        "id",
        "kind",
        F.count(F.lit(1)).over(group).alias("members"),
        F.count(F.when(less, 1)).over(group).alias("replaced"),
        F.count(F.when(F.col("kind") == 1, 1)).over(group).alias("longer"),
        F.min(F.when(F.col("kind") == 1, entry)).over(group).alias("best_longer"),
        F.min(F.when(F.col("kind") == 2, entry)).over(group).alias("shorter"),
        F.min(F.when(less, entry)).over(group).alias("best_replaced"),
        F.lead(F.when(less, entry)).over(ranked).alias("next_replaced"),
    ).where("members > 1")
    other = F.when(F.col("best_replaced.id") == F.col("id"), F.col("next_replaced")).otherwise(F.col("best_replaced"))
    shorter = F.when(F.col("kind") == 1, F.col("shorter"))
    near = F.when(F.col("kind") == 2, F.col("longer")).otherwise(F.col("replaced") - 1 + shorter.isNotNull().cast("long"))
    best = F.when(F.col("kind") == 2, F.col("best_longer")).otherwise(F.least(other, shorter))
    return scanned.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _rooted(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """(id, root): forms followed to the last, twice as far in each step.

    A form is ``factor`` times as frequent as its word, so the chain is as long as the logarithm of the largest count.
    """
    at = forms.select("id", F.col("form_id").alias("root"))
    length, reach = 1, 1
    while factor**length <= most:
        length += 1
    while reach < length:
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = materialise(at.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "spelling-roots")
        reach *= 2
    return at


def variants(docs: DataFrame, least: int = LEAST, often: int = OFTEN, factor: int = FACTOR, damage: int = DAMAGE) -> DataFrame:
    """Per word: word, n, n_near, its form (the most frequent near word, if ``factor`` times as frequent), form_n and root."""
    counted = word_counts(docs, least, often, damage)
    numbered = materialise(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = neighbours(numbered)
    better = -F.col("best.loss") >= F.col("n") * factor
    known = materialise(
        numbered.select("id", "n").join(near, "id", "left").select(
            "id", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.id")).alias("form_id"), F.when(better, -F.col("best.loss")).alias("form_n")
        ),
        "spelling-near",
    )
    most = known.agg(F.max("n")).first()[0] or 0
    roots = _rooted(known.where("form_id IS NOT NULL"), most, factor)
    linked = known.join(roots, "id", "left").withColumn("root_id", F.coalesce("root", "id")).drop("root")
    text = lambda name: numbered.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name))
    return (
        linked.join(numbered.select("id", "word"), "id")
        .join(text("form"), "form_id", "left")
        .join(text("root"), "root_id")
        .select("word", "n", "n_near", "form", "form_n", "root")
    )
