import re

import pytest
from pyspark.sql import functions as F

from jobtally.llm.tables import importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["bucket", "slice", "digest", "host", "fp", "hub", "a", "b", "h", "salt", "rank", "score", "shard", "held", "anchors", "starts", "__n", "key"]
PASSAGE = " ".join(f"passage{i}" for i in range(30))


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def split(text):
    return WORD.findall(text or "")


TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, f"before it all {PASSAGE} and after it some more words of its own"),
    (3, f"other text\twith {PASSAGE}\n{PASSAGE} at the end"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "Word"),
    (8, "Ünïcode wörds ÀÉ joined by no-break space and\x1cothers 日本語 テスト"),
    (9, "same same same same same same same same same same same same same same same same"),
    (10, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (11, " ".join(f"w{i % 977}" for i in range(30000))),
    (12, f"{PASSAGE}"),
    (None, f"no id {PASSAGE}"),
    (13, "line one here\nline one here\n\nline two\r\nline two"),
    (13, "line one here\nline one here\n\nline two\r\nline two"),
    (14, "x" * 5000 + " end"),
    (100, "one two three passage1 passage2 word"),
    (200, f"{PASSAGE} same same"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Odd texts, ids and sources, and extra columns whose names operators use inside."""
    importable(spark)
    rows = [(i, t, None if n % 5 == 0 else f"src{n % 3}", n) for n, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHES}).repartition(5, "n_chars")


@pytest.fixture
def empty(docs):
    return docs.where("n_chars < 0")


@pytest.fixture
def near_copies(spark):
    """Long texts that differ in one word, hundreds of them, beside unlike ones."""
    base = [f"token{i}" for i in range(600)]
    texts = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(300)]
    texts += [" ".join(f"other{k}x{i}" for i in range(50)) for k in range(20)]
    importable(spark)
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(6, "doc_id")
