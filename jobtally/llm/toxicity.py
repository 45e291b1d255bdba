"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. A sample of at most ``SAMPLE`` labelled documents, least hashed ids first, is all that is learned from.
2. Lexicons: fixed lists, and words and word starts whose share of toxic documents is far above that of others. They are
   dealt into groups; each group votes toxic on a hit and abstains otherwise. Patterns vote on shouting, stretched words,
   disguised spelling, direct address, density and variety of hits, and clean where nothing is found.
3. The label model has a table of vote probabilities for each voter and class, found by expectation maximisation; the
   given label is one more voter whose accuracy is estimated. Voters that still agree within a class are correlated; the
   votes of such a cluster count as one together.
4. A logistic regression on the voters' measurements learns the model's posterior labels; its constant is set so that
   the cut that suits the sample's labels best lies at the threshold.
5. All documents are measured and scored in one pass over whole texts.

Language, source and ids are no inputs. Odd input: null and empty texts are scored by the intercept; labels that are
null are left out, repeated ones count by their mean; with no labels or one class the fixed lists vote alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobtally.llm.tables import fold, inner, materialise

SAMPLE = 20_000
TERMS, LEAST_DOCUMENTS, LEAST_ODDS = 2000, 4, 2.5
STARTS = (4, 5, 6)
WORD_GROUPS, START_GROUPS = 10, 6
THRESHOLD = 0.7
REMEMBERED = 300_000

# Common insults and threats.
LISTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool imbecile filth vermin parasite freak jerk creep liar coward shut kill die hate ugly lunatic retard bastard bitch crap damn hell",
    "de": "idiot idioten dumm dummkopf trottel depp arsch abschaum dreck müll blöd blödmann versager widerlich wertlos erbärmlich hass hasse hässlich lügner feigling spinner",
    "fr": "idiot idiote imbécile crétin connard abruti débile stupide minable ordure salaud merde nul nulle dégoûtant pathétique menteur lâche haine moche bouffon",
    "es": "idiota imbécil estúpido estúpida tonto tonta basura asqueroso patético inútil payaso escoria mierda perdedor mentiroso cobarde odio feo cretino cabrón",
}
YOU = frozenset("you your youre u du dich dir dein deine ihr tu toi te ton ta vous votre usted tú ti".split())
_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"(?<!\w)(?=\w*[^\W\d_])[^\W_@$!]*[0-9@$!][\w@$!]*[^\W\d_](?!\w)")
_UNDO = str.maketrans("013457@$!", "oieastasi")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")

GROUPS = [*(f"words_{i}" for i in range(WORD_GROUPS)), *(f"starts_{i}" for i in range(START_GROUPS)), *(f"list_{k}" for k in LISTS)]
PATTERNS = ["disguised", "addressed", "shouting", "stretched", "exclaimed", "dense", "varied", "repeated_hits", "clean", "long_clean"]
VOTERS = [*GROUPS, *PATTERNS]


@dataclass
class Lexicon:
    words: dict[str, int]
    starts: dict[str, int]

    def groups(self, word: str) -> tuple[int, ...]:
        found = {self.words[word]} if word in self.words else set()
        for n in STARTS:
            if len(word) >= n and word[:n] in self.starts:
                found.add(self.starts[word[:n]])
        found.update(GROUPS.index(f"list_{k}") for k, listed in _LISTED.items() if word in listed)
        return tuple(sorted(found))


_LISTED = {k: frozenset(v.split()) for k, v in LISTS.items()}


class Known(dict):
    """Groups of words met so far; emptied when full."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.lexicon.groups(word)
        return found


def measure(text: str, known: Known) -> np.ndarray:
    """What each voter goes by."""
    x = np.zeros(len(VOTERS))
    words = _WORD.findall(text.lower())
    hits = list(filter(None, map(known.__getitem__, words)))
    n = max(len(words), 1)
    for groups in hits:
        x[list(groups)] += 1
    at = len(GROUPS)
    if hits:
        places = [i for i, w in enumerate(words) if known[w]]
        x[at + 1] = sum(any(w in YOU for w in words[max(0, i - 4) : i + 5]) for i in places)
        x[at + 5] = 100 * len(hits) / n
        x[at + 6] = len({words[i] for i in places})
        x[at + 7] = len(hits)
    if any(c in text for c in "013457@$!"):
        x[at] = sum(bool(known[_WORD.match(t.lower().translate(_UNDO)).group()]) for t in _DISGUISED.findall(text) if _WORD.match(t.lower().translate(_UNDO)))
    x[at + 2] = 2 * sum(map(str.isupper, text)) > len(text)
    x[at + 3] = bool(_STRETCHED.search(text))
    x[at + 4] = text.count("!") / n > 0.2
    clean = not hits and not x[at]
    x[at + 8] = clean
    x[at + 9] = clean and len(words) > 50
    return x


def votes(x: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstains; one column per voter."""
    v = (x > 0).astype(np.int8)
    at = len(GROUPS)
    v[:, at + 5] = x[:, at + 5] > 1
    v[:, at + 6] = x[:, at + 6] >= 3
    v[:, at + 7] = x[:, at + 7] >= 2
    v[:, at + 8 :] *= -1
    return v


def inputs(x: np.ndarray) -> np.ndarray:
    """The classifier's inputs: damped measurements and a constant."""
    return np.concatenate([np.log1p(x), (x[:, : len(GROUPS)].sum(axis=1, keepdims=True) > 0), np.ones((len(x), 1))], axis=1)


def terms(text: str) -> Iterator[str]:
    """Different words, and word starts marked by a star."""
    found = set(_WORD.findall(text.lower()))
    yield from found
    yield from {w[:n] + "*" for w in found for n in STARTS if len(w) >= n}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            (toxic if y >= 0.5 else clean).update(terms(text.as_py() or ""))
    every = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[t] for t in every], pa.int64()), pa.array([clean[t] for t in every], pa.int64())], ["term", "toxic", "clean"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms far more frequent in toxic documents, dealt by strength over the groups."""
    n = sample.agg(F.sum((F.col("toxic") >= 0.5).cast("long")).alias("toxic"), F.sum((F.col("toxic") < 0.5).cast("long")).alias("clean")).first()
    n1, n0 = n["toxic"] or 0, n["clean"] or 0
    odds = lambda c, total: F.log((F.col(c) + 0.5) / (F.lit(total + 0.5) - F.col(c)))
    counted = sample.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counted.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("odds", odds("toxic", n1) - odds("clean", n0)).where(F.col("odds") >= LEAST_ODDS)
    words, starts = {}, {}
    if n1 and n0:
        for r in strong.orderBy(F.desc("odds"), "term").limit(TERMS).collect():
            if r["term"].endswith("*"):
                starts[r["term"][:-1]] = WORD_GROUPS + len(starts) % START_GROUPS
            else:
                words[r["term"]] = len(words) % WORD_GROUPS
    return Lexicon(words, starts)


def _measured(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    known = Known(lexicon)
    for batch in batches:
        x = [measure(t.as_py() or "", known).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.binary())], ["toxic", "x"])


def _expect(v: np.ndarray, tables: np.ndarray, prior: float, weights: np.ndarray) -> np.ndarray:
    """Posterior of toxic; tables: for each voter, class and vote the probability."""
    log = np.log(tables)
    score = np.full(len(v), np.log(prior) - np.log(1 - prior))
    for j in range(v.shape[1]):
        score += weights[j] * (log[j, 1] - log[j, 0])[v[:, j] + 1]
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _maximise(v: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    tables = np.ones((v.shape[1], 2, 3))
    for j in range(v.shape[1]):
        for c, q in ((0, 1 - p), (1, p)):
            tables[j, c] += np.bincount(v[:, j] + 1, q, 3)
    tables /= tables.sum(axis=2, keepdims=True)
    return tables, float(np.clip(p.mean(), 1e-3, 1 - 1e-3))


def _clusters(v: np.ndarray, p: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Weight of each voter: one over the size of its cluster of voters that are correlated within a class."""
    m = v.shape[1]
    linked = np.zeros((m, m), bool)
    for q in (p, 1 - p):
        total = max(q.sum(), 1e-9)
        centred = v - (q @ v) / total
        cov = (centred * q[:, None]).T @ centred / total
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            linked |= np.nan_to_num(cov / np.outer(sd, sd)) > least
    np.fill_diagonal(linked, True)
    for _ in range(m):
        linked = (linked.astype(int) @ linked.astype(int)) > 0
    return 1 / linked.sum(axis=1)


def label_model(v: np.ndarray, y: np.ndarray | None, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Posterior labels, and the accuracy weight of every voter (the given label last, if any)."""
    if y is not None:
        v = np.column_stack([v, np.where(y >= 0.5, 1, -1)]).astype(np.int8)
        p = np.where(y >= 0.5, 0.95, 0.05)
    else:
        p = 1 / (1 + np.exp(-v.sum(axis=1, dtype=float)))
    weights = np.ones(v.shape[1])
    for turn in range(rounds):
        # Before the first step, lest a crowd of correlated voters outvotes the labels; then with what was learned.
        if turn == rounds // 2 or turn == 0 and y is not None:
            weights = _clusters(v.astype(float), p)
            if y is not None:
                weights[-1] = 1.0  # the label is evidence of its own
        tables, prior = _maximise(v, p)
        p = _expect(v, tables, prior, weights)
    return p, weights


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - p) + penalty * w
        hessian = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def shift(z: np.ndarray, y: np.ndarray) -> float:
    """What to add to the classifier's sums so that the cut with the best F1 on the labels lies at ``THRESHOLD``."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(z[1:] < z[:-1] - 1e-9, True)  # equal sums stay together
    best = int(np.argmax(np.where(last, f1, -1)))
    cut = (z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best]
    return float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """docs (doc_id, text) and labels (doc_id, toxic) to a lexicon and the classifier's weights."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_size)
    # At most ``sample_size`` rows of two numbers.
    sample = materialise(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    lexicon = learn_lexicon(sample)
    found = sample.mapInArrow(lambda batches: _measured(batches, lexicon), "toxic double, x binary").collect()
    if not found:
        return lexicon, np.zeros(inputs(np.zeros((1, len(VOTERS)))).shape[1])
    x = np.frombuffer(b"".join(r["x"] for r in found)).reshape(len(found), -1)
    y = np.array([r["toxic"] for r in found])
    both = 0 < (y >= 0.5).sum() < len(y)
    p, _ = label_model(votes(x), y if both else None)
    weights = logistic(inputs(x), p)
    if both:
        weights[-1] += shift(inputs(x) @ weights, y >= 0.5)
    return lexicon, weights


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = Known(lexicon)
    for batch in batches:
        x = np.array([measure(t.as_py() or "", known) for t in batch.column("text")]).reshape(-1, len(VOTERS))
        score = 1 / (1 + np.exp(-np.clip(inputs(x) @ weights, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])


def scores(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document; labels of held-out ids (fold 1 of 3) are never read."""
    own = inner(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    given = inner(labels, doc_id=id_col, toxic=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held)
    lexicon, weights = fit(own, given, sample_size)
    scored = own.withColumn("held_out", held).mapInArrow(lambda batches: _score(batches, lexicon, weights), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
