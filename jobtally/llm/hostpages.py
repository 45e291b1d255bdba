"""Main text of web pages: zones from markup, and a suffix array per host that finds the boilerplate.

A page becomes a stream of blocks, each with its zone: ``article`` (inside an article or main element), ``chrome``
(menus, footers, sidebars, forms, and elements named like notices, adverts or comments) or ``open`` (anything else).
The token streams of a host's pages are joined and their suffixes sorted by the first ``DEPTH`` tokens, by doubling. A
run of tokens that recurs in enough different pages of the whole host is boilerplate. Pages whose open and article text
is the same count once, as the one of least hash, so copies of a page are no evidence. Blocks are kept when they are

* in an article, and not covered by runs that also recur outside articles on enough pages, and in ``LEAST_PAGES``
  articles: that articles alone repeat a text (headings, quotes, near copies) is no evidence against it, nor that a
  sidebar lists a heading, or
* open, on a page without an article, and not covered by recurring runs, or
* open, on a page with an article, where counts can tell: blocks of ``DEPTH`` tokens at least, on hosts of
  ``LEAST_PAGES`` different pages at least, not covered by recurring runs.

The different pages of a host are dealt into shards of about ``SHARD`` by their hash. There are fewer shards than the
pages that make a run recur, so such a run stands in two pages of some shard at least. What does is counted in all
shards; counts add up, as a page is in one shard. So a host is judged as a whole, and no task gathers more than a shard.
Shards pass the shuffle in ``TURNS`` turns, each of which frees its files: beside the parsed pages, only a share of their
texts is on disk at a time.
Odd input: null html and pages without blocks give the empty text; pages without a url form one host; null or repeated
page ids are pages of their own.
"""

from __future__ import annotations

import functools
import html as references
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from jobtally.llm import words as W
from jobtally.llm.tables import inner, materialise

DEPTH = 8  # tokens; a power of two
LEAST_PAGES, LEAST_SHARE, MOST_PAGES = 3, 0.2, 300  # a share of a host's pages, but never more than MOST_PAGES
COVER = 0.8
SHARD = 1500
TURNS = 4
PARSED = "page_id long, url string, host string, zones binary, body binary, twin long, variant long, fresh boolean, open boolean, salt long"
COUNTED = "host string, h long, pages long, outside long, inside long, use boolean"
ARTICLE, OPEN, CHROME = 0, 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|title|textarea|iframe)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Elements and names that markup gives to what is no article.
_CHROME_TAGS = frozenset("nav footer aside form dialog menu button select option label input fieldset head".split())
_CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsby\w*|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|widget|menu|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|notif\w*|alert|popup|modal|overlay"
    r"|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comment\w*|respond|replies|disqus|pagination|pager|tags?|copyright|legal|top-?bar|toolbar|skip-?links?|contentinfo|complementary|dialog)(?:$|[\s_-])",
    re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_IMPLIED = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))


def _chrome(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _CHROME_TAGS or tag == "header" and not inside or "hidden" in attributes and _HIDDEN.search(attributes):
        return True
    if tag in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    return any(_CHROME_NAMES.search(a or b or c) for a, b, c in _NAMES.findall(attributes))


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open block elements and the zone outside them
    zone, text, at = OPEN, [], 0

    def close() -> None:
        if text:
            joined = " ".join(references.unescape("".join(text)).split())
            if joined:
                out.append((zone, joined))
            text.clear()

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if m.group(2):
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None:
                close()
                zone = stack[place][1]
                del stack[place:]
            elif tag not in _INLINE:
                close()
            continue
        inside = zone == ARTICLE
        if tag in _INLINE and not (m.group(4) and _chrome(tag, m.group(4), inside)):
            continue
        close()
        if tag in _VOID:
            continue
        if tag in _IMPLIED and stack and stack[-1][0] == tag:
            zone = stack.pop()[1]
        stack.append((tag, zone))
        if zone != CHROME:
            zone = CHROME if _chrome(tag, m.group(4), inside) else ARTICLE if tag in _ARTICLE_TAGS or re.search(r"\brole\s*=\s*[\"']?main", m.group(4)) else zone
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def ranks(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each suffix its rank by the first ``depth`` tokens, by doubling; equal starts have equal ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def repeated(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each suffix its rank by the first ``depth`` tokens, or -1 if these stand nowhere else; such suffixes leave the doubling at once."""

    def ranked(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = times[which] > 1
        rank = np.full(len(tokens), -1, np.int64)
        rank[at[again]] = which[again]
        return rank

    rank = ranked(np.arange(len(tokens)), tokens)
    step = 1
    while step < depth:
        at = np.flatnonzero(rank[: len(tokens) - step] >= 0) if step < len(tokens) else np.zeros(0, np.int64)
        at = at[rank[at + step] >= 0]
        rank = ranked(at, rank[at] * len(tokens) + rank[at + step])
        step *= 2
    return rank


def run_pages(tokens: np.ndarray, page: np.ndarray, twin: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``depth`` tokens of one page start, and in how many different pages those tokens stand.

    twin: for each page a number that pages of the same text share.
    """
    n = len(tokens)
    if n < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(page[: n - depth + 1] == page[depth - 1 :])
    rank = ranks(tokens, depth)[at]
    same = np.unique(twin, return_inverse=True)[1]
    different = np.unique(rank * (int(same.max()) + 1) + same[page[at]])
    pages = np.bincount(different // (int(same.max()) + 1), minlength=int(rank.max(initial=-1)) + 1)
    return at, pages[rank]


def covered(often: np.ndarray, n: int, depth: int = DEPTH) -> np.ndarray:
    """Whether each of ``n`` tokens is in a run that starts at one of the places ``often``."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, often, 1)
    np.subtract.at(cover, often + depth, 1)
    return np.cumsum(cover)[:-1] > 0


def recurring(tokens: np.ndarray, page: np.ndarray, twin: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Whether each token is in a run of ``depth`` or more tokens that recurs over pages."""
    at, pages = run_pages(tokens, page, twin, depth)
    return covered(at[pages >= max(LEAST_PAGES, min(MOST_PAGES, LEAST_SHARE * len(np.unique(twin))))], len(tokens), depth)


def _hash(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64).view(np.int64)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    least: dict[tuple, int] = {}  # of each text of a host, the least variant so far
    for batch in batches:
        for rows in W.slices(batch, batch.schema.get_field_index("html"), 8_000_000):
            found = [blocks(h.as_py()) for h in rows.column("html")]
            zones = [bytes(z for z, _ in b) for b in found]
            twin = _hash(["\n".join(t for z, t in b if z != CHROME) for b in found])
            variant = _hash(["\n".join(f"{z}{t}" for z, t in b) for b in found])
            fresh = []
            for key, own in zip(zip(rows.column("host").to_pylist(), twin.tolist()), variant.tolist()):
                fresh.append(key not in least or own < least[key])
                if fresh[-1]:
                    least[key] = own
            columns = [
                pa.array(zones, pa.binary()),
                pa.array([zlib.compress("\n".join(t for _, t in b).encode(), 1) for b in found], pa.binary()),
                pa.array(twin),
                pa.array(variant),
                pa.array(fresh, pa.bool_()),
                pa.array([OPEN in z for z in zones], pa.bool_()),
                pa.array(np.random.default_rng().integers(0, 1 << 62, len(found))),
            ]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("page_id", "url", "host")), *columns], [c.split()[0] for c in PARSED.split(", ")])


def _texts(zones: bytes, body: bytes) -> list[str]:
    """The blocks of a page; they have no line ends inside."""
    return zlib.decompress(body).decode().split("\n") if zones else []


class _Shard:
    """Blocks and tokens of some pages."""

    def __init__(self, rows: pd.DataFrame):
        zones = [np.frombuffer(z, np.uint8) for z in rows["zones"]]
        sizes = np.array([len(z) for z in zones], np.int64)
        self.flat = [t for page in rows["texts"] for t in page]
        self.zone = np.concatenate([*zones, np.zeros(0, np.uint8)])
        self.edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        page_of_block = np.repeat(np.arange(len(rows)), sizes)
        w = W.words(pa.array(self.flat, pa.string()))
        self.block, self.tokens = w.owners(), w.hashes
        self.page = page_of_block[self.block]
        first = np.searchsorted(self.page, np.arange(len(rows) + 1))
        self.at, self.runs = W.windows(W.Words(w.data, w.starts, w.ends, w.hashes, first), DEPTH)
        self.runs = self.runs.view(np.int64)

    def share(self, frequent: np.ndarray) -> np.ndarray:
        """Of each block, the share of tokens in frequent runs."""
        inside = covered(self.at[np.isin(self.runs, frequent)], len(self.tokens))
        return np.bincount(self.block[inside], minlength=len(self.flat)) / np.maximum(np.bincount(self.block, minlength=len(self.flat)), 1)


def _counts(rows: pd.DataFrame, wanted: np.ndarray | None = None) -> pd.DataFrame:
    """Each run that stands twice in the shard, or each that is wanted: in how many different pages it stands, in how many outside and inside articles, and whether it covers open text."""
    rows = _unpacked(rows)
    shard = _Shard(rows)
    if wanted is None:
        rank = repeated(shard.tokens)[shard.at]
        asked = rank >= 0
    else:
        rank = shard.runs
        asked = np.isin(shard.runs, wanted)
    at, runs, rank = shard.at[asked], shard.runs[asked], rank[asked]
    if not len(at):
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("h", "pages", "outside", "inside")}).assign(use=pd.Series([], dtype=bool))
    _, first, rank = np.unique(rank, return_index=True, return_inverse=True)
    page, zone = shard.page[at], shard.zone[shard.block]

    def of_zone(kind: int) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(zone == kind)])
        return before[at + DEPTH] - before[at]

    def pages(where: np.ndarray) -> np.ndarray:
        different = np.unique(rank[where] * len(rows) + page[where])
        return np.bincount(different // len(rows), minlength=len(first))

    article = of_zone(ARTICLE)
    use = np.bincount(rank, of_zone(OPEN) > 0, len(first)) > 0
    counts = {"pages": pages(article >= 0), "outside": pages(article == 0), "inside": pages(article == DEPTH)}
    return pd.DataFrame({"h": runs[first], **counts, "use": use})


PACKED = "host string, shard long, shards long, least double, pages binary, zones binary, texts binary, size long"
PAGE = np.dtype([("twin", np.int64), ("variant", np.int64), ("blocks", np.int64)])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a batch in one row per shard, as texts of a host compress better together."""
    squeeze = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        rows = batch.to_pandas()
        found = []
        for (host, shard), own in rows.groupby(["host", "shard"], sort=False):
            pages = np.empty(len(own), PAGE)
            pages["twin"], pages["variant"], pages["blocks"] = own["twin"], own["variant"], own["zones"].str.len()
            texts = "\n".join(t for page in zip(own["zones"], own["body"]) for t in _texts(*page)).encode()
            found.append((host, shard, own["shards"].iloc[0], own["least"].iloc[0], pages.tobytes(), b"".join(own["zones"]), squeeze.compress(texts, asbytes=True), len(texts)))
        names = [c.split()[0] for c in PACKED.split(", ")]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=names), preserve_index=False)


def _unpacked(rows: pd.DataFrame) -> pd.DataFrame:
    """The different pages of a shard."""
    squeeze, found = pa.Codec("zstd"), []
    for pages, zones, texts, size in zip(rows["pages"], rows["zones"], rows["texts"], rows["size"]):
        pages = np.frombuffer(pages, PAGE)
        edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(pages["blocks"])])
        flat = squeeze.decompress(texts, size, asbytes=True).decode().split("\n") if size else []
        found += [(t, v, zones[a:b], flat[a:b]) for t, v, a, b in zip(pages["twin"].tolist(), pages["variant"].tolist(), edge[:-1], edge[1:])]
    return pd.DataFrame(found, columns=["twin", "variant", "zones", "texts"]).sort_values("variant").drop_duplicates("twin")


def _candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts of runs that so many pages of a shard hold that the host may reach its limit; for hosts of one shard, they are final."""
    found = _counts(rows)
    return _counted(rows, found[found["pages"] >= rows["least"].iloc[0] / rows["shards"].iloc[0]])


def _wanted(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """Counts of the wanted runs in a shard; shards of a host may have no page."""
    return _counted(rows, _counts(rows, wanted["h"].to_numpy(np.int64)))


def _counted(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    return found.assign(host=rows["host"].iloc[0] if len(rows) else "")[[c.split()[0] for c in COUNTED.split(", ")]]


def _keep(rows: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
    """The main text of pages of a host, whose frequent runs are given."""
    shard = _Shard(rows.assign(texts=[_texts(*page) for page in zip(rows["zones"], rows["body"])]))
    runs, article = frequent["h"].to_numpy(np.int64), frequent["article"].to_numpy(bool)
    sizes = np.bincount(shard.block, minlength=len(shard.flat))
    page_of_block = np.repeat(np.arange(len(rows)), np.diff(shard.edge))
    has_article = np.bincount(page_of_block[shard.zone == ARTICLE], minlength=len(rows)) > 0
    tells = (sizes >= DEPTH) & (rows["pages"].to_numpy()[page_of_block] >= LEAST_PAGES) | ~has_article[page_of_block]
    kept = (shard.zone == ARTICLE) & (shard.share(runs[article]) < COVER) | (shard.zone == OPEN) & tells & (shard.share(runs) < COVER)
    texts = ["\n".join(shard.flat[i] for i in range(a, b) if kept[i]) for a, b in zip(shard.edge[:-1], shard.edge[1:])]
    return pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": pd.Series(texts, index=rows.index, dtype=object)})


def _articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main text of pages without open text, on hosts that have no boilerplate in articles."""
    for batch in batches:
        texts = ["\n".join(t for z, t in zip(zones, _texts(zones, body)) if z == ARTICLE) for zones, body in zip(batch.column("zones").to_pylist(), batch.column("body").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def frequent_runs(dealt: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, h, article) of the runs that reach the limit of their host, and whether they go from articles, too; ``dealt``
    has the different pages of ``hosts``."""
    shard = ("host", "shard")
    own = dealt.select(*shard, "shards", "least", "zones", "body", "twin", "variant")

    def in_turns(count: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], name: str) -> DataFrame:
        """What ``count`` finds in the shards, a share of them after the other; it gets what picks the rows of a share."""
        turns = [lambda df, turn=turn: df.where(F.pmod(F.xxhash64(*shard), F.lit(TURNS)) == turn) for turn in range(TURNS)]
        return functools.reduce(DataFrame.unionByName, [materialise(count(share), name) for share in turns])

    found = in_turns(lambda share: share(own).mapInArrow(_pack, PACKED).groupBy(*shard).applyInPandas(_candidates, COUNTED), "runs")
    one = hosts.select("host", (F.col("shards") == 1).alias("one"))
    counted = found.join(one.where("one"), "host", "left_semi")
    wanted = found.join(one.where("NOT one"), "host", "left_semi").select("host", "h").distinct()
    told = wanted.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "h")
    asked = own.join(wanted.select("host").distinct(), "host", "left_semi")
    parts = in_turns(lambda share: share(asked).mapInArrow(_pack, PACKED).groupBy(*shard).cogroup(share(told).groupBy(*shard)).applyInPandas(_wanted, COUNTED), "parts")
    sums = [F.sum(c).alias(c) for c in ("pages", "outside", "inside")]
    counted = counted.unionByName(parts.groupBy("host", "h").agg(*sums, F.max("use").alias("use")))
    article = (F.col("outside") >= F.col("least")) & (F.col("inside") >= LEAST_PAGES)
    reached = counted.join(hosts.select("host", "least"), "host").where("pages >= least").select("host", "h", article.alias("article"), "use")
    return materialise(reached.where("use OR article").select("host", "h", "article"), "frequent")


def main_text(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    own = inner(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host)
    parsed = materialise(own.mapInArrow(_parse, PARSED), "parsed")
    twins = parsed.groupBy("host", "twin").agg(F.count(F.lit(1)).alias("rows"))
    counts = twins.groupBy("host").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.lit(float(LEAST_PAGES)), F.least(F.lit(float(MOST_PAGES)), LEAST_SHARE * F.col("pages")))
    shards = F.least(F.ceil(F.col("pages") / SHARD), F.ceil("least") - 1)
    hosts = materialise(counts.withColumn("least", least).withColumns({"shards": shards, "deal": F.ceil(F.col("rows") / SHARD)}), "hosts")
    dealt = parsed.where("fresh").join(hosts.where(F.col("pages") >= LEAST_PAGES), "host").withColumn("shard", F.pmod("twin", "shards"))
    frequent = frequent_runs(dealt, hosts)
    # The rest is as markup has it: nothing open, and no run of the host that goes from articles.
    in_articles = frequent.where("article").select("host", F.lit(True).alias("judged")).distinct()
    ready = parsed.join(hosts.select("host", "pages", "deal"), "host").join(in_articles, "host", "left")
    to_judge = F.col("open") | F.coalesce("judged", F.lit(False))
    left = ready.where(to_judge).select("page_id", "url", "host", F.pmod("salt", "deal").alias("shard"), "zones", "body", "pages").groupBy("host", "shard")
    told = frequent.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1)).alias("shard"), "h", "article")
    schema = "page_id long, url string, text string"
    decided = ready.where(~to_judge).select("page_id", "url", "zones", "body").mapInArrow(_articles, schema)
    found = decided.unionByName(left.cogroup(told.groupBy("host", "shard")).applyInPandas(lambda rows, runs: _keep(rows, runs), schema))
    return found.withColumn("n_chars", F.length("text").cast("long"))
