"""Main text of pages, toxicity against held-out labels, and the pipeline's stages."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from jobtally.llm import hostpages, toxicity
from jobtally.llm.tables import importable
from llm.conftest import split

# Pages.


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []),
        ("", []),
        ("plain text &amp; more", [(1, "plain text & more")]),
        ("<article><h1>T&eacute;</h1><p>a <b>b</b>c<br>d<p>e\n\t f</article><footer>x</footer>", [(0, "Té"), (0, "a bc"), (0, "d"), (0, "e f"), (2, "x")]),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes", [(1, "yes")]),
        ("<nav><ul><li>menu</ul></nav><main><p>body<div class='comments'><p>first!</div><p>end</main>", [(2, "menu"), (0, "body"), (2, "first!"), (0, "end")]),
        ("<div class='cookie-notice'>We use</div><header><h1>Site</h1></header><aside>s</aside><form>f<input></form>", [(2, "We use"), (2, "Site"), (2, "s"), (2, "f")]),
        ("<div class=\"loads of headers\">kept</div><div id=sidebar>gone</div>", [(1, "kept"), (2, "gone")]),
        ("<article><p>a &lt;b&gt; &nbsp; c<unclosed", [(0, "a <b> c")]),
        ("<script>never closed <p>x", []),
    ],
)
def test_blocks(page, expected):
    assert hostpages.blocks(page) == expected


@pytest.mark.parametrize("seed", range(5))
def test_recurring_runs_against_brute_force(seed):
    rng = random.Random(seed)
    depth, pages = 4, 12
    texts = [[rng.randrange(6) for _ in range(rng.randrange(0, 40))] for _ in range(pages)]
    twin = np.array([k % 9 for k in range(pages)])
    tokens = np.array([t for text in texts for t in text])
    page = np.repeat(np.arange(pages), [len(t) for t in texts])
    seen = {}
    for k, text in enumerate(texts):
        for i in range(len(text) - depth + 1):
            seen.setdefault(tuple(text[i : i + depth]), set()).add(twin[k])
    expected = []
    for text in texts:
        cover = [False] * len(text)
        for i in range(len(text) - depth + 1):
            if len(seen[tuple(text[i : i + depth])]) >= 3:
                cover[i : i + depth] = [True] * depth
        expected += cover
    assert hostpages.recurring(tokens, page, twin, depth).tolist() == expected


@pytest.mark.parametrize("seed", range(5))
def test_repeated_ranks_against_all_ranks(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 3, 9, 400):
        tokens = rng.integers(0, 3, n).astype(np.uint64)
        found = hostpages.repeated(tokens)
        starts = [tuple(tokens[i : i + 8].tolist()) for i in range(n)]
        for i in range(n):
            alone = len(starts[i]) < 8 or starts.count(starts[i]) == 1
            assert (found[i] < 0) == alone
            assert alone or [j for j in range(n) if found[j] == found[i]] == [j for j in range(n) if starts[j] == starts[i]]


@pytest.fixture
def pages(spark):
    importable(spark)
    own = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    shell = "<div>Welcome to our invented shop where all things are sold at good prices</div><div>{0}</div><div>Terms and conditions of our invented shop apply to every single order placed</div>"
    rows = [(k, f"https://shop.example.org/{k}", shell.format(own(k)), "own") for k in range(12)]
    rows += [(20 + k, "http://blog.example.com/x", f"<nav>menu</nav><article><h1>Same</h1><p>{own(99)}</p></article><p>after</p>", "own") for k in range(4)]
    rows += [(30, None, None, "own"), (31, "no url", "", "own"), (None, "http://blog.example.com/y", "<p>only this</p>", "own"), (31, "no url", "", "own")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


@pytest.mark.parametrize("shard", [hostpages.SHARD, 5])
def test_main_text(pages, shard, monkeypatch):
    monkeypatch.setattr(hostpages, "SHARD", shard)
    found = hostpages.main_text(pages).collect()
    assert len(found) == pages.count()
    texts = {r.page_id: r.text for r in found}
    for k in range(12 if shard > 5 else 0):  # a few pages are too few to tell
        assert texts[k] == " ".join(f"word{k}x{i}" for i in range(30))
    for k in range(4):
        assert texts[20 + k] == "Same\n" + " ".join(f"word99x{i}" for i in range(30))
    assert texts[30] == texts[31] == "" and texts[None] == "only this"
    assert all(r.n_chars == len(r.text) for r in found)
    assert hostpages.main_text(pages.where("page_id < 0")).collect() == []


@pytest.mark.parametrize("shard", [hostpages.SHARD, 5])
def test_a_host_is_judged_as_a_whole(pages, spark, shard, monkeypatch):
    """Whatever the shards, and however often a row is repeated."""
    monkeypatch.setattr(hostpages, "SHARD", shard)
    copies = spark.createDataFrame([(None, None, "<p>just some text that is the same each time it is read</p>", "own")] * 40, pages.schema)
    found = hostpages.main_text(pages.unionByName(copies)).collect()
    texts = {r.page_id: r.text for r in found if r.page_id is not None}
    assert len(found) == pages.count() + 40
    for k in range(12):
        assert texts[k] == " ".join(f"word{k}x{i}" for i in range(30))
    assert sum(r.text.startswith("just some text") for r in found) == 40


def test_a_notice_on_many_pages_goes_however_large_the_host(spark):
    importable(spark)
    notice = "<div>Our invented office is closed for all of the coming week</div>"
    rows = [(k, f"https://large.example.org/{k}", (notice if k % 6 == 0 else "") + "<p>" + " ".join(f"word{k}x{i}" for i in range(9)) + "</p>") for k in range(2000)]
    found = hostpages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in found) == [(k, " ".join(f"word{k}x{i}" for i in range(9))) for k in range(2000)]


def _text(k, n=12, word="word"):
    return " ".join(f"{word}{k}x{i}" for i in range(n))


@pytest.mark.parametrize("shard", [hostpages.SHARD, 5])
def test_counts_decide_beside_an_article(spark, shard, monkeypatch):
    """Open text beside an article stays if it is unique and goes if it recurs; a host too small to tell leaves it to markup."""
    monkeypatch.setattr(hostpages, "SHARD", shard)
    importable(spark)
    notice = "<div>Our invented office is closed for all of the coming week</div>"
    page = lambda k: f"{notice}<main><p>teaser {k}</p></main><div>{_text(k)}</div><p>next</p>"
    rows = [(k, f"https://news.example.org/{k}", page(k)) for k in range(12)] + [(20, "https://one.example.org/", page(20))]
    found = hostpages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {**{k: f"teaser {k}\n{_text(k)}" for k in range(12)}, 20: "teaser 20"}


@pytest.mark.parametrize("shard", [hostpages.SHARD, 5])
def test_counts_decide_inside_an_article(spark, shard, monkeypatch):
    """What recurs outside articles goes inside them, too; what only articles repeat stays, and a heading that a sidebar lists."""
    monkeypatch.setattr(hostpages, "SHARD", shard)
    importable(spark)
    notice = "Our invented office is closed for all of the coming week"
    quote = "As our invented founder used to say every day is a new day"
    heading = "A heading of nine words that each sidebar lists here"
    rows = []
    for k in range(24):
        inside = f"<p>{notice}</p>" if k % 2 else ""
        outside = "" if k % 2 else f"<div class=notice>{notice}</div>"
        title = f"<h1>{heading}</h1>" if k == 7 else ""
        rows.append((k, f"https://news.example.org/{k}", f"{outside}<aside><p>{heading}</p></aside><article>{title}<p>{_text(k)}</p>{inside}<p>{quote}</p></article>"))
    found = hostpages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: (f"{heading}\n" if k == 7 else "") + f"{_text(k)}\n{quote}" for k in range(24)}


@pytest.mark.parametrize("shard", [hostpages.SHARD, 5])
def test_texts_are_written_once_and_shuffled_in_shares(spark, shard, monkeypatch):
    """Beside the parsed pages no table has texts, and no step shuffles those of all pages at once."""
    monkeypatch.setattr(hostpages, "SHARD", shard)
    importable(spark)
    tables = []
    real = hostpages.materialise

    def written(df, name, *more):
        out = real(df, name, *more)
        tables.append((name, df.columns))
        return out

    monkeypatch.setattr(hostpages, "materialise", written)
    monkeypatch.setattr(hostpages, "write_table", lambda df, name, *more: pytest.fail(f"table {name} beside the parsed pages"), raising=False)
    notice = "<div>Our invented office is closed for all of the coming week</div>"
    rows = [(k, f"https://site{k % 8}.example.org/{k}", f"{notice}<p>{_text(k)}</p>") for k in range(160)]
    found = hostpages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: _text(k) for k in range(160)}
    assert [name for name, columns in tables if {"body", "different"} & set(columns)] == ["parsed"]
    assert [name for name, _ in tables].count("runs") == hostpages.TURNS > 1


# Toxicity.


@pytest.fixture
def labelled(spark):
    """Clean words, and insults of an invented language that only labels tell."""
    importable(spark)
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(rng.randrange(20, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "grzbl" + rng.choice(["", "a", "en", "ix", "ou"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), 0.5))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "no id at all", "x")]
    labels += [(None, 1, 0.5), (0, 1, 0.5), (3, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, score double")


def test_toxicity_learns_words_from_labels(labelled):
    docs, labels = labelled
    found = toxicity.scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 600]
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held)
    assert len(held) > 150 and right / len(held) > 0.97
    assert all(not r.predicted for r in found if r.doc_id is None or r.doc_id >= 1000)


def test_held_out_labels_are_never_read(labelled):
    docs, labels = labelled
    changed = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    by_id = lambda df: {r.doc_id: round(r.score, 9) for r in df.collect()}
    assert by_id(toxicity.scores(docs, labels)) == by_id(toxicity.scores(docs, changed))


def test_toxicity_without_labels_uses_the_lists(spark, labelled):
    docs, labels = labelled
    insults = spark.createDataFrame([(1, "you are a pathetic idiot and a moron"), (2, "a fine day in the hills")], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.scores(insults, labels.where("false")).collect()}
    assert scores[1] >= scores[2]
    assert toxicity.scores(docs.where("false"), labels).collect() == []


def test_label_model_weighs_copies_of_a_voter_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, np.where(y, 1, -1), 0) * np.where(rng.random(4000) < 0.9, 1, -1) for _ in range(3)]
    bad = np.where(rng.random(4000) < 0.6, np.where(y, 1, -1), np.where(y, -1, 1))
    votes = np.column_stack([*good, *[bad] * 6]).astype(np.int8)
    noisy = np.where(rng.random(4000) < 0.95, y, ~y).astype(float)
    p, weights = toxicity.label_model(votes, noisy)
    assert np.allclose(weights[3:9], 1 / 6) and np.allclose(weights[:3], 1) and weights[9] == 1
    assert ((p > 0.5) == y).mean() > 0.95


# Pipeline.


def test_pipeline_stages(docs, tmp_path):
    columns = docs.select("doc_id", "text", "key", "source", "n_chars").withColumnRenamed("key", "lang")
    step, kept = columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(docs.sparkSession, step, str(tmp_path)), name)
        if name != "pack":
            assert out.columns == columns.columns
            kept[name] = {r.doc_id: r.text for r in out.collect()}
            assert all(r.n_chars == len(r.text) for r in out.where("text is not null").collect() if name != "near_dedup")
        step = out
    assert 9 not in kept["quality_rules"] and 5 not in kept["quality_rules"] and 2 in kept["quality_rules"]
    assert 1 in kept["near_dedup"] and 10 not in kept["near_dedup"]
    assert "passage5" in kept["substring_dedup"][2] and "passage5" not in kept["substring_dedup"][200]
    assert {r.doc_id for r in step.collect()} == set(kept["mask_private"])


def test_every_operator_has_a_registered_query():
    from jobtally.llm import queries

    assert [name.split("_")[0] for name in queries.registered()] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


def test_word_helper_agrees_with_the_pattern():
    import pyarrow as pa

    from jobtally.llm import words as W

    texts = ["a  b\tc\n\nd", "", None, " x ", "é ü\x1c y\x0bz", "A a B b", "tail"]
    w = W.words(pa.array(texts), lower=True)
    flat = [t for text in texts for t in split(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    assert w.counts.tolist() == [len(split(t)) for t in texts]
    assert [len(set(w.hashes[np.array(flat) == t].tolist())) for t in set(flat)] == [1] * len(set(flat))
    assert len(set(w.hashes.tolist())) == len(set(flat))


def test_capitals_count_over_the_whole_text():
    """Texts whose layout once fell in step with a sample of their characters, and long ones that shout late."""
    known = toxicity.Known(toxicity.Lexicon({}, {}))
    at = len(toxicity.GROUPS) + 2
    shouts = lambda text: toxicity.measure(text, known)[at]
    assert shouts("aB" * 10000) == shouts("Ba" * 10000) == 0
    assert shouts("aBB" * 10000) == shouts("BBa" * 10000) == 1
    assert shouts("a" * 9000 + "B" * 9001) == 1 and shouts("B" * 9000 + "a" * 9000) == 0
    assert shouts("") == 0
