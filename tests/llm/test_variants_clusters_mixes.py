"""Spelling variants, centroid clusters and mixes against brute force, with odd input and clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtally.llm import centroids, mixing, queries, spelling
from jobtally.llm.tables import importable
from llm.conftest import CLASHES, lower, split

UNDERSCORED = ["__id", "__text", "__digest", "__kept", "row", "draw", "size", "part", "its_source", "copies", "id", "word", "n", "root", "cluster", "slice"]


def extended(df):
    return df.withColumns({name: F.lit(f"own {name}") for name in UNDERSCORED if name not in df.columns})


# Spelling variants.


def counted(docs, least=7, often=2, damage=31):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least
    return {word: n for word, n in found.items() if n >= often}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_variants(counts, factor=10):
    near = {word: [o for o in counts if abs(len(o) - len(word)) < 2 and one_edit(word, o)] for word in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= factor * counts[word] else None
    out = set()
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        out.add((word, counts[word], len(near[word]), form[word], counts[form[word]] if form[word] else None, root))
    return out


@pytest.fixture(scope="module")
def spelled(spark):
    """Chains of ever rarer forms, runs of equal letters, ties, accents, words as long as the limit of plain rotations and far longer."""
    importable(spark)
    long, longest = "long" * 16, "ab" * 4000
    words = {
        "abcdefgh": 1200, "abcdefgx": 100, "abcdefyx": 6, "abcdefgg": 3, "abcdefg": 2, "aabbccdd": 40, "abbccdd": 2, "aaabbccdd": 3,
        "zzzzzzz": 2, "zzzzzzzz": 40, "zzzzzzzzz": 400, "tieoneword": 30, "tietwoword": 30, "tie" + "o" + "eword": 2, "tiexneword": 3,
        "ÀÉîôûüß": 30, "ÀÉîôûüÿ": 3, "àÉîôûüß": 2, "×÷×÷×÷×": 25, "×÷×÷×÷÷": 2, "single": 50, "onlyonce": 1,
        long[:63]: 25, long: 3, long[:62] + "xx": 2, long + "l": 2, long[:40] + "x" + long[40:]: 30, longest: 20, longest[:4000] + longest[4001:]: 2, longest[:-1] + "c": 2,
    }
    rows = [(1000 + i, " ".join(w.upper() if i % 3 == 0 and w.isascii() else w for w, n in words.items() if n > i)) for i in range(1200)]
    rows += [(None, "abcdefgh onlytwice onlytwice"), (None, None), (1, ""), (2, "short words do not count 12345678"), (1000, rows[0][1])]
    return rows


def test_spelling_variants_against_brute_force(spark, spelled):
    df = extended(spark.createDataFrame(spelled, "doc_id long, text string").repartition(7))
    found = {tuple(r) for r in spelling.variants(df).collect()}
    expected = all_variants(counted(spelled))
    assert found == expected
    assert any(w == "abcdefyx" and root == "abcdefgh" for w, *_, root in found)  # over abcdefgx
    assert max(len(w) for w, *_ in found) == 8000


def test_spelling_finds_edits_of_every_kind(spark, docs):
    importable(spark)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ab"), rng.integers(7, 10))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40))) for i in range(300)]
    found = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), factor=2).collect()}
    assert found == all_variants(counted(rows), 2) and any(r[2] > 5 for r in found)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(docs).collect()} == all_variants(counted(texts))


def test_spelling_of_nothing(empty):
    found = spelling.variants(empty)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"] and found.count() == 0


def test_long_rotations_are_told_apart():
    for n in (62, 63, 64, 65, 66):
        word = "".join(chr(97 + i * i % 26) for i in range(n))
        keys = [key for key, _ in spelling.rotations(word)]
        assert len(set(keys)) == len(keys) == 2 * n + 1
        longer = word[:30] + "!" + word[30:]
        shared = set(keys) & {key for key, _ in spelling.rotations(longer)}
        assert len(shared) == 1
        replaced = word[:30] + "!" + word[31:]
        assert len(set(keys) & {key for key, _ in spelling.rotations(replaced)}) == 1


def test_spelling_rotations_are_linear_in_the_word():
    keys = spelling.rotations("x" * 100_000)
    assert len(keys) == 200_001 and max(len(key) for key, _ in keys) < 50


# Centroid clustering.


def lloyd(rows, k=16, rounds=3, dims=64, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(means)), key=lambda c: (away(v, means[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = defaultdict(list)
        for c, (_, v) in zip(assign(), kept):
            own[c].append(v)
        means = [[sum(x) // len(own[c]) for x in zip(*own[c])] if own[c] else means[c] for c in range(len(means))]
    found = [(i, c, away(v, means[c])) for (i, v), c in zip(kept, assign())]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=repr)


def vectors(spark, rows, kind="float"):
    importable(spark)
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({name: F.lit(0) for name in [*CLASHES, *UNDERSCORED]})


def test_clusters_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "SLICE", 37)
    rng = np.random.default_rng(3)
    spots = rng.normal(0, 0.5, (9, 64))
    rows = [(i, np.float32(spots[i % 9] + rng.normal(0, 0.1, 64)).tolist()) for i in range(600)]
    rows += [(1000, [0.5] * 64)] * 40  # one vector many times
    rows += [(2000 + i, rows[i][1]) for i in range(50)]
    rows += [(None, [0.25] * 64), (3000, None), (3001, []), (3002, [0.5] * 63), (3003, [0.5] * 65), (3004, [0.5] * 63 + [None])]
    rows += [(3005, [math.inf] + [0.1] * 63), (3006, [math.nan] + [0.1] * 63), (3007, [-0.0] * 64), (3008, [1000.0] * 64), (3009, [-2000.5] * 64)]
    df = vectors(spark, rows).repartition(5)
    found = centroids.cluster(df)
    expected = lloyd(rows)
    assert sorted((tuple(r) for r in centroids.with_inertia(found).collect()), key=repr) == expected
    assert found.scanned[0] == len(expected) and len(found.scanned) == 3


def test_ties_and_few_vectors(spark):
    near = [(i, [float(i % 3)] * 64) for i in range(30)]
    for rows in (near, near[:5], [(1, [0.0] * 64)] * 40, near[:1]):
        assert sorted((tuple(r) for r in centroids.with_inertia(centroids.cluster(vectors(spark, rows, "double"))).collect()), key=repr) == lloyd(rows)


def test_clusters_of_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-(1 << 18), 1 << 18, 64) + 0.5).tolist()) for i in range(200)]
    assert sorted((tuple(r) for r in centroids.with_inertia(centroids.cluster(vectors(spark, rows, "double"))).collect()), key=repr) == lloyd(rows)
    with pytest.raises(Exception, match="components beyond"):
        centroids.cluster(vectors(spark, [(1, [1e30] * 64)], "double"))


def test_clusters_of_nothing(spark):
    df = vectors(spark, [(1, [0.5] * 64)])
    for rows in (df.where("false"), df.withColumn("embedding", F.lit(None).cast("array<float>"))):
        found = centroids.with_inertia(centroids.cluster(rows))
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and found.count() == 0


def test_heaps_scan_only_what_expired():
    rng = np.random.default_rng(1)
    rows = np.int32(rng.integers(0, 9, (500, 4)) * 100 + rng.integers(0, 5, (500, 4)))
    row = {"width": 4, "data": rows.tobytes()}
    means = np.array([[100, 100, 100, 100], [700, 700, 700, 700], [100, 700, 100, 700]], np.int64)
    drift, total = np.zeros(3), np.zeros((3, 5), np.int64)
    scanned = []
    for _ in range(8):
        heaps, change, seen = centroids.settle(row, 4, means, drift)
        total, scanned = total + change, [*scanned, seen]
        nearest = centroids.distances(rows, means).argmin(axis=1)
        assert heaps.cluster.tolist() == nearest.tolist()
        assert [total[c, 4] for c in range(3)] == np.bincount(nearest, minlength=3).tolist()
        for heap in heaps.heaps:
            assert all(heap[i] <= heap[j] for i in range(len(heap)) for j in (2 * i + 1, 2 * i + 2) if j < len(heap))
        moved = np.array([t[:4] // t[4] for t in total])
        drift, means = drift + centroids.drifts(means, moved), moved
        row = row | heaps.columns()
    assert scanned[0] == 500 and scanned[-1] < 250


# Mixing.


def shares(sizes, weights, most):
    """Targets by pouring: whoever is above its bound gets the bound, the rest is poured anew."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        rest = [i for i in range(len(sizes)) if i not in capped]
        target = {i: weights[i] * left / (sum(weights[j] for j in rest) or 1) for i in rest}
        above = {i for i in rest if target[i] > most * sizes[i]}
        if not above:
            return [most * sizes[i] if i in capped else target[i] for i in range(len(sizes))]
        capped |= above


def mixed(rows, most=3):
    size = lambda text: len(split(text))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sums = [sum(size(t) for _, t, s in rows if s == source) for source in sources]
    target = dict(zip(sources, shares(sums, [1 + i % 3 for i in range(len(sums))], most)))
    sums = dict(zip(sources, sums))
    rate = {s: target[s] / sums[s] if sums[s] else 0 for s in sources}

    def taken(doc_id, text, source, seed):
        key = str(doc_id) if doc_id is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"mix:{seed}:{key}".encode()).hexdigest()[:12], 16) / 2**48
        return size(text) * (math.floor(rate[source]) + (draw < rate[source] % 1))

    def missed(source, seed):
        return abs(sum(taken(*row, seed) for row in rows if row[2] == source) - target[source])

    seed = {s: min(range(16), key=lambda i: (missed(s, i), i)) for s in sources}
    return sorted(((i, size(t), sums[s], float(target[s]), taken(i, t, s, seed[s])) for i, t, s in rows), key=repr)


def thin(df):
    return sorted((tuple(r) for r in df.selectExpr("doc_id", "size", "source_size", "target", "size * copies").collect()), key=repr)


def test_mix_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    assert thin(mixing.copies(extended(docs))) == mixed(rows)


def test_mix_of_a_hot_source_and_tiny_ones(spark):
    rng = np.random.default_rng(2)
    names = [*["hot"] * 4000, *[f"s{i % 40}" for i in range(4000)], *["tiny"] * 3, *["Zero"] * 3, *[None] * 20, *["é"] * 30, *["\U0001f600"] * 5, *["￿"] * 2]
    rows = [(i if i % 50 else None, " ".join(["w"] * (0 if s == "Zero" else int(rng.integers(0, 60)) * (100 if i % 100 == 7 else 1))), s) for i, s in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = mixing.copies(df)
    assert thin(found) == mixed(rows) == thin(mixing.copies(df.repartition(3)))
    target, taken, size = found.selectExpr("sum(if(source = 'hot', size / source_size * target, 0))", "sum(if(source = 'hot', size * copies, 0))", "sum(size)").first()
    assert abs(taken - target) < 0.01 * target
    assert abs(found.selectExpr("sum(size * copies)").first()[0] - size) < 0.05 * size
    assert found.where("copies > 3").count() == 0


def test_mix_repeats_rows(spark, docs):
    wanted = mixing.copies(docs).selectExpr("sum(copies)").first()[0]
    assert wanted > 0
    wide = extended(docs)
    found = mixing.mix(wide)
    assert found.columns == wide.columns and found.count() == wanted
    assert found.where("__id <> 'own __id' OR copies <> 'own copies' OR row <> 'own row'").count() == 0


def test_mix_of_nothing(spark, empty, docs):
    assert mixing.copies(empty).count() == 0 == mixing.mix(empty).count()
    blank = mixing.copies(docs.withColumn("text", F.lit(None).cast("string")))
    assert {(r["target"], r["copies"]) for r in blank.collect()} == {(0.0, 0)}


def test_new_queries_are_registered():
    assert {"op11_spelling_variants", "op12_centroid_clustering", "op13_source_mixing"} <= set(queries.registered())
