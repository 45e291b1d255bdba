"""Operators on documents against brute force, with odd input and clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.conftest import CLASHES, lower, split
from jobtally.llm import bm25, bytebpe, classlm, packing, private, quality, repeats, simhash, words as W
from jobtally.llm.tables import importable

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def listed(df):
    return [r.asDict() for r in df.collect()]


# Quality rules.


def base_counts(text):
    words = split(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    found = listed(quality.judge(docs))
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    assert len(found) == docs.count()
    for r in found:
        counts = tuple(r[c] for c in quality.COUNTS)
        assert counts == base_counts(texts[r["doc_id"]][0]), r["doc_id"]
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.fixture
def boilerplate(spark, docs):
    """A host whose footer is in most documents, one document that is little else, and copies of a long document."""
    own = [f"own{k}w{i}" for k in range(60) for i in range(12)]
    footer = "All rights of this invented footer line are reserved"
    rows = [(k, " ".join(own[12 * k : 12 * k + 12]) + "\n" + footer.upper(), "h") for k in range(40)]
    rows.append((50, f"{footer}\nfew words left here {footer[:10]}", "h"))
    rows += [(100 + k, "a long text that many copies share with one\nanother line of the copied text for good measure", "h") for k in range(40)]
    rows.append((200, footer + "\n" + " ".join(own[:30]), "other"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_frequent_lines_go_and_depleted_documents_are_rejected(boilerplate):
    kept = {r["doc_id"]: r for r in listed(quality.judge(boilerplate))}
    assert not kept[50]["kept"] and not kept[50]["base_failed"]
    assert all(kept[k]["kept"] and kept[k]["removed_words"] == 9 for k in range(40))
    assert all(kept[100 + k]["kept"] and not kept[100 + k]["removed_words"] for k in range(40))
    cleaned = {r["doc_id"]: r["text"] for r in listed(quality.clean(boilerplate))}
    assert 50 not in cleaned and "footer" in cleaned[200] and cleaned[3] == " ".join(f"own3w{i}" for i in range(12)) + "\n"


def test_lines_of_a_template_go_however_many_it_has(spark):
    importable(spark)
    template = [f"menu entry{i}" for i in range(40)]
    own = [" ".join(f"own{k}w{i}" for i in range(30)) for k in range(300)]
    rows = [(k, "\n".join([*template[:10], own[k], *template[10:]]), "h") for k in range(300)]
    verdicts = listed(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(r["kept"] and r["removed_words"] == 80 for r in verdicts)
    cleaned = listed(quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(r["text"].strip() == own[r["doc_id"]] for r in cleaned) and len(cleaned) == 300


# Substring dedup.


def brute_repeats(rows, window=13):
    first = {}
    for i, text in rows:
        words = split(text)
        for k in range(len(words) - window + 1):
            if i is not None:
                w = tuple(words[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        words, gone = split(text), set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=repr)


def test_repeats(docs):
    found = repeats.remove_repeats(docs)
    assert set(docs.columns) <= set(found.columns)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = found.select("doc_id", "__n_words", "__n_removed", "__kept", "__left").collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == brute_repeats(rows)
    assert all(split(r["__left"]) == split(r["__kept"]) for r in got)
    assert found.select("host").distinct().collect()[0][0] == "own host"


def test_repeats_of_shorter_windows(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = repeats.remove_repeats(docs, window=7, block=4).select("doc_id", "__n_words", "__n_removed", "__kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, 7)
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, window=12, block=7)


# SimHash.


def brute_fingerprint(text):
    words = split(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    """fps: id to fingerprint."""
    ids = sorted(fps)
    name = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= bits and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = {k: low if v == high else v for k, v in name.items()}
    return name


def test_simhash(docs):
    found = listed(simhash.near_duplicates(docs))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(found) == docs.count()
    assert all(r["fp"] % (1 << 64) == brute_fingerprint(texts[r["doc_id"]]) for r in found)
    names = brute_components({i: brute_fingerprint(t) for i, t in texts.items() if i is not None})
    assert all(r["component_id"] == names[r["doc_id"]] for r in found if r["doc_id"] is not None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(names.values()))


@pytest.mark.parametrize("hot", [simhash.HOT, 8])
def test_near_copies_in_plain_and_overlarge_files(near_copies, hot):
    texts = {r.doc_id: r.text for r in near_copies.collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    names = brute_components(fps)
    assert 2 < len(set(names.values())) < len(names)
    assert {r["doc_id"]: r["component_id"] for r in listed(simhash.near_duplicates(near_copies, hot=hot))} == names


def test_file_keys_hold_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = a.copy()
    for i, row in enumerate(b):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a.view(np.int64), b.view(np.int64))], "a long, b long")
    pairs = df.select(simhash.file_keys("a").alias("x"), simhash.file_keys("b").alias("y")).collect()
    assert all(set(r.x) & set(r.y) for r in pairs) and all(len(r.x) == 20 for r in pairs)


# Personal data.


def brute_private(text):
    text, out = text or "", []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else 0, 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


MESSY = [
    "a@b.c@d.e f.g+h@x-y.z..q @x.y a@ a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3", "4111 1111-1111 1111 0 4111111111111111x41111",
    "+49 (170) 123-4567 +1 +12345678901234567 ++123456789", "é@ü.de ü1.1.1.1é", "9" * 3000, "@" * 50, "a" * 3000 + "@b.cd", "+1.2.3.4567890 4242424242424242", "",
]


@pytest.mark.parametrize("text", MESSY)
def test_base_spans(text):
    assert private.detect(text) == brute_private(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane [at] example [dot] org today", "email", "jane [at] example [dot] org"),
        ("write to jane(at)example(dot)co(dot)uk", "email", "jane(at)example(dot)co(dot)uk"),
        ("so jane at example dot org it is", "email", None),
        ("jаne@exаmple.org", "email", "jаne@exаmple.org"),
        ("x １９２.168.0.1 y", "ip", "１９２.168.0.1"),
        ("call plus four nine one seven zero one two three four five six now", "phone", "plus four nine one seven zero one two three four five six"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("4111​1111​1111​1111", "card", "4111​1111​1111​1111"),
    ],
)
def test_disguises(text, kind, source):
    base, added = private.find(text)
    assert base == brute_private(text)
    assert [private.KINDS[k] for _, k, _ in added] == [kind]
    if source:
        assert text[added[0][0] : added[0][2]] == source


@pytest.mark.parametrize("text", ["meet me at noon and dot the page", "un deux trois quatre", "the point at issue", "Größe über alles", "look at this. Then go."])
def test_clean_texts_have_no_spans(text):
    assert private.find(text) == ([], [])


def test_find_private(docs, spark):
    found = listed(private.find_private(docs))
    assert len(found) == docs.count() and not any(r["spans"] for r in found)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MESSY)], "doc_id long, text string")
    for r in listed(private.find_private(df)):
        spans = brute_private(MESSY[r["doc_id"]])
        assert [r[f"n_{k}"] for k in private.KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{private.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in listed(private.mask(df))}
    assert masked[0] == "[EMAIL]@d.e [EMAIL]..q @x.y a@ a@b a@b."
    assert private.mask(docs).columns == docs.columns


# Byte-level BPE.


def test_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.load_ranks(BPE), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in listed(bytebpe.tokens(docs, BPE, public_tokenizers.PATTERN)):
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    for r in listed(bytebpe.tokens(docs, BPE, public_tokenizers.PATTERN, full=False)):
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_long_pieces_follow_the_same_rule():
    own = bytebpe.bpe(BPE)
    pieces = ["ab" * 40, "the" * 30, "-" * 90, "é" * 50, "日本語" * 12, "zzqx" * 20, "tionthtion" * 9]
    coded = [",".join(map(str, own.long_ids(p.encode()))).encode() for p in pieces]
    assert own._code([p.encode() for p in pieces]) == (coded, [p.encode() for p in pieces])
    long = "".join(pieces) * 2
    ids, decoded = own._code([long.encode()])
    assert decoded == [long.encode()] and ids[0].count(b",") + 1 == len(own.long_ids(long.encode()))


# Packing.


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.select("doc_id", "text").collect()}
    found = listed(packing.pack_documents(docs, WORDS))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    for i, spans in pieces.items():
        copies = 2 if i == 13 else 1
        assert sum(n for _, n in spans) == copies * len(ids[i])
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(empty, WORDS).collect() == []


def test_patterns_hold_every_piece_and_little_room():
    rng = np.random.default_rng(3)
    histogram = Counter(int(x) for x in np.minimum(rng.exponential(400, 20000) + 1, 2048))
    packs = packing.patterns(histogram)
    held = Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 2048
        for x in lengths:
            held[x] += n
    assert held == histogram
    assert sum(k * v for k, v in histogram.items()) > 0.99 * 2048 * sum(n for _, n in packs)
    assert len(packs) <= 2 * 2048


# Language model.


def test_class_model(docs, empty):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = listed(classlm.score(docs, least=3, classes=4, rounds=6))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*split(lower(t)), None] for i, t in texts.items()}
    counts = Counter(t for i in texts for _ in range(2 if i == 13 else 1) if not held(i) for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(found) == docs.count() and any(r["held_out"] for r in found)
    for r in found:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(own), n)
        assert r["n_known"] == sum(counts[t] > 0 for t in own)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert classlm.score(empty).collect() == []


def test_class_probabilities_sum_to_one(spark, docs):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'xy'[k % 2]}{rng.integers(40)}" for k in range(60)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, out boolean")
    totals = Counter(t for text in texts for t in split(lower(text)))
    ordered = sorted(totals.values(), reverse=True)
    least = ordered[29]
    assert ordered[30] < least
    slices = df.selectExpr("doc_id", "text", "out as held").mapInArrow(classlm._slices, classlm.SLICES).cache()
    dealt = slices.mapInArrow(lambda b: classlm._deal(b, 4), "bucket int, slice long, vocab binary, rules binary, counts binary")

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return classlm._count(key, rows, least)

    counted = dealt.groupBy("bucket").applyInPandas(count, classlm.COUNTED)
    model = classlm.fit(slices, counted, 4, 9)
    assert model.words == 30
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    listed_words = {w for w, _ in sorted(totals.items(), key=lambda x: -x[1])[:30]}
    rest = {w: c for w, c in totals.items() if w not in listed_words}
    known = sum((c - model.discount) for c in rest.values())
    tail = model.totals[model.classes[model.words + 1 :]]
    assert math.isclose(known + sum(t * 10**h for t, h in zip(tail, model.held_back[model.classes[model.words + 1 :]]) if t), sum(rest.values()), rel_tol=1e-6)
    # x and y words take turns: no class holds both, apart from words met rarely.
    score = listed(classlm.score(df, held="out", least=1, classes=4))
    assert sum(r["score"] for r in score) > sum(r["base_score"] for r in score)


def class_table(bigrams, classes, size):
    table = np.zeros((size, size))
    for (a, b), n in bigrams.items():
        table[classes[a], classes[b]] += n
    return table


def some_bigrams(seed, symbols, tokens):
    rng = np.random.default_rng(seed)
    text = np.minimum(rng.geometric(0.06, tokens), symbols) - 1
    text[rng.random(tokens) < 0.1] = 3  # also after itself
    return Counter(zip(text[:-1].tolist(), text[1:].tolist()))


@pytest.mark.parametrize("seed", range(4))
def test_best_class_against_recounted_likelihood(seed):
    movable, symbols = 5, 40
    bigrams = some_bigrams(seed, symbols, 3000)
    classes = np.random.default_rng(seed).integers(0, movable, symbols)
    classes[-2:] = movable, movable + 1  # those that stay
    size = movable + 2
    table = class_table(bigrams, classes, size)
    for word in range(symbols - 2):
        after = sum((n * np.eye(size)[classes[b]] for (a, b), n in bigrams.items() if a == word), np.zeros(size))
        before = sum((n * np.eye(size)[classes[a]] for (a, b), n in bigrams.items() if b == word), np.zeros(size))
        best, gain = classlm.best_class(classes[word], after, before, bigrams[word, word], table, movable)
        by_class = []
        for c in range(movable):
            moved = classes.copy()
            moved[word] = c
            by_class.append(classlm.likelihood(class_table(bigrams, moved, size)) - classlm.likelihood(table))
        assert math.isclose(gain, max(by_class), rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(by_class[best], max(by_class), rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("block", [500, 7])
def test_exchange_ends_where_no_word_gains(spark, docs, block, monkeypatch):
    monkeypatch.setattr(classlm, "BLOCK", block)
    movable, words, size = 5, 37, 40  # the end, words, two classes by rule
    bigrams = some_bigrams(9, size, 6000)
    packed = [(k, *[np.array(x, np.int64).tobytes() for x in zip(*[(a * size + b, n) for (a, b), n in bigrams.items() if a % 3 == k])]) for k in range(3)]
    pairs = spark.createDataFrame(packed, classlm.PACKED)
    before, _ = classlm.exchange(pairs, words, size, movable, 0)
    assert before.tolist() == [movable, *[i % movable for i in range(words)], movable + 1, movable + 2]
    classes, table = classlm.exchange(pairs, words, size, movable, 100)
    total = movable + size - words
    assert np.array_equal(table, class_table(bigrams, classes, total))
    assert classlm.likelihood(table) > classlm.likelihood(class_table(bigrams, before, total)) + 10
    if block == 500:  # one block: the plain algorithm, word by word
        plain, moving = before.copy(), True
        while moving:
            moving = False
            for word in range(1, words + 1):
                options = []
                for c in range(movable):
                    tried = plain.copy()
                    tried[word] = c
                    options.append(classlm.likelihood(class_table(bigrams, tried, total)))
                if max(options) > options[plain[word]] + 1e-4:
                    plain[word], moving = int(np.argmax(options)), True
        assert classes.tolist() == plain.tolist()
    for word in range(1, words + 1):
        for c in range(movable):
            tried = classes.copy()
            tried[word] = c
            assert classlm.likelihood(class_table(bigrams, tried, total)) < classlm.likelihood(table) + 1e-2


def test_few_words_are_moved_by_their_own_lists(spark, docs, monkeypatch):
    """Rows of blocks stay small, and once few words gain, the lists of the others are not read to move these."""
    monkeypatch.setattr(classlm, "BLOCK", 7)
    movable, words, size = 5, 37, 40
    bigrams = some_bigrams(9, size, 6000)
    packed = [(0, *[np.array(x, np.int64).tobytes() for x in zip(*[(a * size + b, n) for (a, b), n in bigrams.items()])])]
    real, listed = classlm.Exchange.move, []

    def move(self, found, blocks, of, rest):
        whole = class_table(bigrams, self.assigned, len(self.table))
        assert np.array_equal(rest + self.summed(blocks, classlm._class_counts, self.assigned, of), whole)
        listed.append(int(of.sum()))
        return real(self, found, blocks, of, rest)

    monkeypatch.setattr(classlm.Exchange, "move", move)
    classlm.exchange(spark.createDataFrame(packed, classlm.PACKED), words, size, movable, 100)
    assert listed[0] == words and any(n <= classlm.FEW * words for n in listed)
    assert classlm.ENTRIES * 16 <= 1 << 21


def test_blocks_of_a_task_know_the_moves_of_those_before(spark, docs, monkeypatch):
    """One task: what its moves gain together is what the likelihood gains, though its words lie in six blocks."""
    monkeypatch.setattr(classlm, "BLOCK", 7)
    movable, words, size = 5, 37, 40
    bigrams = some_bigrams(9, size, 6000) + Counter({(1, 2): 254, (2, 1): 70000})
    packed = [(0, *[np.array(x, np.int64).tobytes() for x in zip(*[(a * size + b, n) for (a, b), n in bigrams.items()])])]
    path, number = classlm._blocks(spark.createDataFrame(packed, classlm.PACKED), words, size)
    blocks = spark.read.schema(classlm.BLOCKS).parquet(path)
    assert number == blocks.count() == 6
    classes = np.concatenate([[movable], np.arange(words) % movable, [movable + 1, movable + 2]])
    before = class_table(bigrams, classes, movable + 3)
    (found,), _ = classlm.Exchange(classes, before, movable).moves(blocks, 1)
    after = classes.copy()
    after[found.symbol] = found.to
    assert found.moved > 10
    assert math.isclose(found.gain, classlm.likelihood(class_table(bigrams, after, movable + 3)) - classlm.likelihood(before), rel_tol=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_no_move_gains_more_than_hoped(seed):
    movable, symbols = 5, 40
    size = movable + 2
    bigrams = some_bigrams(seed, symbols, 3000)
    classes = np.random.default_rng(seed).integers(0, movable, symbols)
    classes[-2:] = movable, movable + 1
    table = class_table(bigrams, classes, size)
    counts = np.zeros((symbols, 2, size))
    for (a, b), n in bigrams.items():
        counts[a, 0, classes[b]] += n
        counts[b, 1, classes[a]] += n
    words = np.arange(symbols - 2)
    twice = np.array([bigrams[w, w] for w in words], float)
    hopes = classlm.Sweep(classes, table, movable, 0.0).hopes(counts[words], classes[words], twice)
    for w in words:
        gain = classlm.gains(classes[w], *counts[w], twice[w], table, movable, classlm.Sums.of(table))
        gain[classes[w]] = -np.inf
        assert gain.max() <= hopes[w] + 1e-9


@pytest.mark.parametrize("others", [0, 3000])
def test_the_same_words_are_clustered_however_large_the_corpus(spark, docs, monkeypatch, others):
    texts = [" ".join([*(f"often{k}" for k in range(20)), f"seldom{i % 60}"]) for i in range(300)]
    texts += [" ".join(f"once{i}x{k}" for k in range(10)) for i in range(others)]
    real, words = classlm.fit, []

    def fit(*given):
        words.append(real(*given))
        return words[-1]

    monkeypatch.setattr(classlm, "fit", fit)
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, out boolean")
    assert classlm.score(df, held="out", classes=4, rounds=1).count() == len(texts)
    assert words[0].words == 20


def test_seldom_words_join_the_classes_that_suit_them(spark, docs, monkeypatch):
    """Every word of the training documents is clustered; what it gives to unknown words is all that classes by rule keep."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'xy'[k % 2]}{rng.integers(60)}" for k in range(60)) for _ in range(40)]
    rows = [(i, f"{t} new{i}" if i % 8 == 0 else t, i % 8 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean").repartition(3)
    real, seen = classlm.settle, []

    def settle(numbered, model, *given):
        seen.extend([model, real(numbered, model, *given)])
        return seen[1]

    monkeypatch.setattr(classlm, "settle", settle)
    scores = {r["doc_id"]: r for r in listed(classlm.score(df, held="out", least=18, classes=4))}
    before, after = seen
    counts = Counter(w for _, t, out in rows if not out for w in t.split())
    assert 0 < before.words < len(counts) and len(after.classes) == before.words + 1 + classlm.RULES + len(counts) - before.words
    known = after.classes[[*range(1, before.words + 1), *range(before.words + 1 + classlm.RULES, len(after.classes))]]
    assert known.max() < 4
    # Neighbours alternate, so two classes of x and two of y, or one with one: no token follows one of its own class.
    assert np.diag(after.table)[:4].sum() < 0.01 * after.tokens
    assert np.allclose((10**after.transitions).sum(axis=1), 1)
    seldom = [n for n in counts.values() if n < 18]
    assert math.isclose(after.table.sum(), after.tokens) and math.isclose(after.totals[5:].sum(), len(seldom) * after.discount)
    assert math.isclose(after.totals[:4].sum(), sum(counts.values()) - len(seldom) * after.discount)
    assert not after.held_back.any()
    left = lambda numbered, model, rules, classes, rounds: replace(model, classes=np.concatenate([model.classes, classes + 1 + rules.astype(np.int64)]))
    monkeypatch.setattr(classlm, "settle", left)
    unjoined = {r["doc_id"]: r["score"] for r in classlm.score(df, held="out", least=18, classes=4).collect()}
    assert len(scores) == len(unjoined) == len(rows)
    assert sum(r["score"] for r in scores.values()) > sum(unjoined.values())
    assert all(math.isfinite(r["score"]) and r["n_tokens"] == len(rows[i][1].split()) + 1 for i, r in scores.items())


@pytest.mark.parametrize("seed", range(2))
def test_seldom_words_take_the_class_that_recounting_finds(seed):
    """A block of words that all stand beside others only: gains agree with a recount of the likelihood."""
    movable, symbols = 4, 40
    size = movable + 3
    classes = np.random.default_rng(seed).integers(0, movable, symbols)
    classes[:20:2] = movable + 1  # not in any class yet
    bigrams = Counter({(a, b): n for (a, b), n in some_bigrams(seed, symbols, 3000).items() if (a < 20) != (b < 20)})
    table = class_table(bigrams, classes, size)
    of = [(2 * a, b, n) for (a, b), n in bigrams.items() if a < 20] + [(2 * b + 1, a, n) for (a, b), n in bigrams.items() if b < 20]
    lists = classlm.Lists.sorted(*[np.array(x) for x in zip(*of)], symbols)
    for word in range(20):
        one = lists.where(lists.symbol == word)
        if not len(one.symbol):
            continue
        row = pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([b], pa.binary()) for b in one.blobs()]], ["block", *classlm.BLOBS])
        found = [r for batch in classlm._joins(iter([row]), classes, table, movable) for r in batch.to_pylist()]
        by_class = []
        for c in range(movable):
            moved = classes.copy()
            moved[word] = c
            by_class.append(classlm.likelihood(class_table(bigrams, moved, size)))
        to = int(np.frombuffer(found[0]["class"], classes.dtype)[0]) if found else int(classes[word])
        # The word's own tokens stay in the table meanwhile, which blurs gains a little.
        assert by_class[to] > max(by_class) - 0.1 * (max(by_class) - min(by_class)) - 0.5


def test_score_of_a_document_by_hand(spark, docs):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'xy'[k % 2]}{min(rng.geometric(0.1), 30)}" for k in range(50)) for _ in range(30)]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    seen = {}
    real = classlm.fit

    def kept(*args):
        seen["model"] = real(*args)
        return seen["model"]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(classlm, "fit", kept)
        scores = {r["doc_id"]: r for r in listed(classlm.score(df, held="out", least=1, classes=3))}
    m = seen["model"]
    counts = Counter(w for _, t, out in rows if not out for w in t.split())
    assert m.words == len(counts)
    ranked = sorted(counts, key=lambda w: -counts[w])
    assert m.tokens == sum(counts.values()) + sum(not out for *_, out in rows)
    # The hashes of words tell which symbol each is.
    number = {w: int(m.symbols.of(W.words(pa.array([w]), lower=True).hashes, np.zeros(1, np.uint8))[0]) for w in ranked}
    assert sorted(number.values()) == list(range(1, len(ranked) + 1))
    assert [counts[w] for w in sorted(ranked, key=number.get)] == sorted(counts.values(), reverse=True)
    klass = {w: int(m.classes[k]) for w, k in number.items()}
    end = int(m.classes[0])
    table, of_class = Counter(), Counter()
    for _, t, out in rows:
        if not out:
            before = end
            for c in [*(klass[w] for w in t.split()), end]:
                table[before, c] += 1
                of_class[c] += 1
                before = c
    size = len(m.totals)
    n = sum(of_class.values())
    prior = {c: (of_class[c] + 1) / (n + size) for c in range(size)}
    outgoing = Counter()
    for (a, _), k in table.items():
        outgoing[a] += k
    for i, t, out in rows:
        if any(w not in counts for w in t.split()):
            continue
        before, expected = end, 0.0
        for w in [*t.split(), None]:
            c = end if w is None else klass[w]
            expected += math.log10((table[before, c] + classlm.BACKOFF * prior[c]) / (outgoing[before] + classlm.BACKOFF))
            expected += 0.0 if w is None else math.log10(counts[w] / of_class[c])
            before = c
        assert math.isclose(scores[i]["score"], expected, rel_tol=1e-9)


# Search.


def brute_search(rows, queries, k):
    counts = [(i, Counter(split(lower(t)))) for i, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for _, c in counts) / len(rows)
    df = Counter(w for _, c in counts for w in c)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in counts:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(split(lower(text))) if w in c)
            if s > 0:
                scores.append((-round(s, 6), 1 << 62 if i is None else i))
        out[q] = sorted(scores)[:k]
    return out


@pytest.mark.parametrize("terms", [bm25.TERMS, 10])
def test_search(docs, terms, monkeypatch):
    monkeypatch.setattr(bm25, "SEED_SHARE", 2)
    queries = docs.where("doc_id % 100 = 0")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = defaultdict(list)
    for r in bm25.top_k(docs, queries, 5, terms_at_once=terms).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 6), 1 << 62 if r.doc_id is None else r.doc_id))
    assert dict(got) == brute_search(rows, [r for r in rows if r[0] and r[0] % 100 == 0], 5)


def test_block_bounds_prune_without_loss():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    from jobtally.llm import words as W

    texts = [" ".join(f"{'abcd'[k % 4]}{int(rng.zipf(1.3)) % 500}" for _ in range(int(rng.integers(1, 80)))) for k in range(600)]
    w = W.words(pa.array(texts), lower=True)
    shard = bm25._shard(0, [(np.arange(600), w.counts, *bm25._postings(w))])
    index = bm25.Index(shard.to_pylist()[0], 40.0)
    for q in range(0, 600, 37):
        words = np.unique(np.searchsorted(index.vocab, W.words(pa.array([texts[q]]), lower=True).hashes))
        idf = rng.random(len(words)) + 0.1
        scores = np.zeros(600)
        for word, x in zip(words, idf):
            at = slice(index.offsets[word], index.offsets[word + 1])
            scores[index.ids[index.docs[at]]] += x * index.part[at]
        expected = np.lexsort((np.arange(600), -np.round(scores, 9)))[:10]
        ids, found = index.top(words, idf, 10, 0.0)
        assert sorted(ids) == sorted(expected) and np.allclose(np.sort(found), np.sort(scores[expected]))
        floor = float(np.sort(found)[4])
        assert set(index.top(words, idf, 10, floor)[0]) >= set(ids[np.argsort(-found)[:5]])


def test_queries_of_a_shard_are_searched_together(monkeypatch):
    """Postings of common words are not walked query by query, and few documents are scored one by one; copies are found by id."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(rng.zipf(1.25)) % 4000}" for _ in range(int(rng.integers(60, 120)))) for k in range(700)]
    texts += [texts[5]] * 20 + ["", "w1"]
    w = W.words(pa.array(texts), lower=True)
    owner, hashes, tf = bm25._postings(w)
    index = bm25.Index(bm25._shard(0, [(np.arange(len(texts))[::-1], w.counts, owner, hashes, tf)]).to_pylist()[0], float(w.counts.mean()))
    asked = [*range(0, 700, 7), 5, 720, 721]
    held = [hashes[owner == q] for q in asked]
    edges, words = np.cumsum([0, *map(len, held)]), np.searchsorted(index.vocab, np.concatenate(held))
    idf = np.log1p((len(texts) - np.diff(index.offsets)[words] + 0.5) / (np.diff(index.offsets)[words] + 0.5))
    expected = []
    for a, b in zip(edges, edges[1:]):
        scores = np.zeros(len(texts))
        for word, x in zip(words[a:b], idf[a:b]):
            at = slice(index.offsets[word], index.offsets[word + 1])
            scores[index.ids[index.docs[at]]] += x * index.part[at]
        scores = np.round(scores, 9)
        best = np.lexsort((np.arange(len(texts)), -scores))[:10]
        expected.append([(int(i), scores[i]) for i in best if scores[i] > 0])
    walked, scored, rest, best = [], [], bm25.Index._rest, bm25.Index._best
    monkeypatch.setattr(bm25, "BATCH", 30 * max(index.table.shape))
    monkeypatch.setattr(bm25.Index, "_rest", lambda self, start, size, idf: walked.append(size.sum()) or rest(self, start, size, idf))
    monkeypatch.setattr(bm25.Index, "_best", lambda self, docs, *given: scored.append(len(docs)) or best(self, docs, *given))
    for floors in (np.zeros(len(asked)), np.array([e[-1][1] if len(e) == 10 else 0.0 for e in expected])):
        walked.clear(), scored.clear()
        found = list(index.tops(edges, words, idf, 10, floors))
        for (ids, scores), rows in zip(found, expected, strict=True):
            assert ids.tolist() == [i for i, _ in rows] and np.allclose(scores, [x for _, x in rows], rtol=1e-9)
        assert sum(walked) < 0.4 * np.diff(index.offsets)[words].sum()
        assert sum(scored) < 0.1 * len(asked) * len(texts)


@pytest.mark.parametrize(
    "operator",
    [quality.judge, quality.clean, repeats.clean, simhash.near_duplicates, simhash.keep_one, private.find_private, private.mask, lambda d: bm25.top_k(d, d), lambda d: bytebpe.tokens(d, BPE, public_tokenizers.PATTERN)],
)
def test_empty_tables(empty, operator):
    assert operator(empty).collect() == []


def test_other_columns_stay(docs):
    for cleaned in (quality.clean(docs), repeats.clean(docs), simhash.keep_one(docs), private.mask(docs)):
        row = cleaned.first().asDict()
        assert all(row[c] == f"own {c}" for c in CLASHES)


@pytest.mark.parametrize("stage", [quality.clean, repeats.clean, simhash.keep_one, private.mask])
def test_columns_named_as_those_of_the_stages_stay(docs, stage):
    plain = docs.select("doc_id", "text", "source", "n_chars")
    names = ["__id", "__ID2", "__no_id", "__digest", "__text", "__host", "__bad", "__kept", "__left", "__starts", "__n_words", "__n_removed", "callers_0"]
    wide = plain.withColumns({name: F.concat(F.lit(name), "n_chars") for name in names})
    found = stage(wide)
    assert found.columns == wide.columns
    assert found.where(" OR ".join(f"`{name}` <> concat('{name}', n_chars)" for name in names)).isEmpty()
    expected = stage(plain)
    assert sorted(map(tuple, found.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_the_pipeline_takes_an_empty_table(spark, tmp_path, empty):
    import corpus_pipeline

    empty.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and "sequence_id" in found.columns
