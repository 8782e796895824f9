"""Main text of web pages, with a suffix array of each host's token streams.

Pages are read once, block by block: markup tells the blocks of the article (article, main, or a container named as
content) and drops menus, headers, footers, sidebars, notices, adverts, forms and comments, inside lines too. All other
blocks of a host's distinct pages go into one token stream; its suffix array gives the runs of at least RUN tokens that
distinct pages share, and how many share them. A block that shared runs cover whole is boilerplate: where a page marks no
article, if two pages share the runs; inside a marked article, where markup speaks for the text, if so many pages' articles
share them that they belong to the site (SITE_SHARE of the host's pages with articles, SITE_PAGES at least). Other blocks stay. Hosts
whose stream is beyond HOST_TOKENS have their suffixes split by the runs they start with, and sorted by Spark.

Defined results: null or empty html gives an empty text; identical pages count as one page of their host; a null or
odd url belongs to the host ''; repeated rows and ties give equal rows; very long pages are read whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm.common import stored, table

#: Tokens of a shared run; block ends count as tokens.
RUN = 8
#: Share of a host's pages with articles, and pages at least, that have a run there if it is the site's.
SITE_SHARE, SITE_PAGES = 0.5, 4
#: Tokens of a host's stream beyond which its suffix array is split.
HOST_TOKENS = 1_000_000
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+)""")
#: Names of elements by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select xmp".split())
DROPPED = frozenset("nav footer aside form header menu dialog button fieldset head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role that mark what is no article, and what is one.
OTHER_WORDS = frozenset(
    "nav navbar navigation menu menubar sidebar side footer contentinfo header masthead banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay dialog newsletter subscribe subscription signup ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social "
    "comment comments disqus reply replies respond discussion related recommended recommendations widget toolbar pagination pager login search complementary skip".split()
)
READER_WORDS = frozenset("comment comments disqus reply replies respond discussion related recommended recommendations".split())
CONTENT_WORDS = frozenset("article articlebody articlecontent content maincontent pagecontent post postbody postcontent entry entrycontent story storybody".split())
#: Words that make a header that of an article.
TITLED = frozenset("article entry post story".split())
PLAIN = frozenset("article main body html h1 h2 h3 h4 h5 h6".split())
#: Fixed values of HTML's tree rules: what an element's start tag ends if open, and what that search does not pass.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_TABLE = frozenset("caption tbody td tfoot th thead tr".split())
IN_HEAD = frozenset("base head link meta noscript script style template title".split())
NO_P_END = IN_TABLE | frozenset("body head html legend optgroup option".split())
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "caption"}, "option": {"option"}, "optgroup": {"optgroup", "option"}}
ENDED |= {n: {"tbody", "thead", "tfoot", "caption"} for n in ("tbody", "thead", "tfoot")}
CELLS = frozenset("button caption table td th".split())
LIMITS = {"li": CELLS | {"ul", "ol", "menu"}, "dt": CELLS | {"dl"}, "dd": CELLS | {"dl"}} | {n: frozenset(["table"]) for n in IN_TABLE}
#: End tags that end their element through open tables too.
SECTIONS = frozenset("article aside body footer head header html main nav section table".split())
#: Parts of an open element: none, a dropped region that an article may end, one of readers' words, a marked container.
NOTHING, REGION, READERS, MARKED = range(4)


@dataclass
class Page:
    """Blocks of a page in order that markup does not drop, as (text, whether inside its marked article)."""

    blocks: list[tuple[str, bool]] = field(default_factory=list)
    marked: bool = False

    def text(self) -> str:
        return "\n\n".join(t for t, inside in self.blocks if inside)


def words_of(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def other_part(name: list[str], inside: bool) -> bool:
    """Whether a class, id or role names what is no article; a header inside an article or of an entry is part of it."""
    said = set(name) & OTHER_WORDS
    return bool(said - {"header"} if inside or set(name) & TITLED else said)


class Open:
    """The open elements of a page, ended as HTML's tree rules do where end tags are left out, and counts of their parts."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.names: Counter[str] = Counter()
        self.parts = [0, 0, 0, 0]

    def push(self, name: str, part: int) -> None:
        self.stack.append((name, part))
        self.names[name] += 1
        self.parts[part] += 1

    def forget(self, at: int) -> None:
        name, part = self.stack.pop(at)
        self.names[name] -= 1
        self.parts[part] -= 1

    def end(self, ended: Collection[str], limits: Collection[str] = (), alone: bool = False) -> None:
        """End the nearest open element named among ended, with all inside it unless alone, if limits do not enclose more."""
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name in ended:
                if alone:
                    self.forget(at)
                else:
                    while len(self.stack) > at:
                        self.forget(-1)
                return
            if name in limits:
                return

    def before(self, name: str) -> None:
        """End what a start tag ends."""
        if self.names.get("head") and name not in IN_HEAD:
            self.end(("head",))
        if self.names.get("p") and name in BLOCKS and name not in NO_P_END:
            self.end(("p",), CELLS)
        if name in ENDED:
            if any(map(self.names.get, ENDED[name])):
                self.end(ENDED[name], LIMITS.get(name, CELLS))
        elif name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.forget(-1)

    def after(self, name: str) -> None:
        """End what an end tag ends."""
        if name in HEADINGS:
            self.end(HEADINGS, CELLS)
        elif not self.names.get(name):
            return
        elif name in BLOCKS:
            self.end((name,), () if name in SECTIONS else LIMITS.get(name, CELLS))
        else:
            self.end((name,), alone=True)

    def reopen(self) -> None:
        """Dropped regions that an article may end are dropped no more."""
        self.stack = [(n, NOTHING if p == REGION else p) for n, p in self.stack]
        self.parts[NOTHING] += self.parts[REGION]
        self.parts[REGION] = 0

    @property
    def dropped(self) -> bool:
        return self.parts[REGION] + self.parts[READERS] > 0


def read_page(source: str) -> Page:
    page, pieces, open_ = Page(), [], Open()

    def add(text: str) -> None:
        if not open_.dropped:
            pieces.append(text)

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                page.blocks.append((text, open_.parts[MARKED] > 0))
            pieces.clear()

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        if not m:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        close, name, rest = m[1], m[2], m[3]
        if close:
            close = close.lower()
            if close in BLOCKS:
                flush()
            open_.after(close)
            continue
        if not name:
            continue
        name = name.lower()
        if name in RAW and not (rest or "").endswith("/"):
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = stop.start() if stop else end
            if name != "title":
                continue
        if name in ("br", "wbr"):
            add(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
        open_.before(name)
        if name in VOID or (name in RAW and name != "title"):
            continue
        part = NOTHING
        said = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest and "=" in rest else {}
        names = [words_of(n) for k in ("class", "id", "role") if k in said for n in said[k].split()]
        labels = {w for n in names for w in n}
        if name in ("article", "main") and not labels & READER_WORDS:
            if not open_.parts[READERS]:
                open_.reopen()
            if not open_.dropped and not open_.parts[MARKED]:
                part = MARKED
        elif (name in DROPPED or (name not in PLAIN and any(other_part(n, open_.parts[MARKED] > 0) for n in names)) or labels & READER_WORDS or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "") or re.search(r"\bhidden\b", ATTRIBUTE.sub("", rest or ""))) and name not in ("body", "html"):
            if not (name == "header" and open_.parts[MARKED]):
                part = READERS if labels & READER_WORDS else REGION
        elif name in ("div", "section") and not open_.parts[MARKED] and not open_.dropped and any("".join(n) in CONTENT_WORDS for n in names):
            part = MARKED
        page.marked |= part == MARKED
        open_.push(name, part)
    flush()
    return page


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


BLOCK_ROWS = "page_id long, url string, host string, key string, marked boolean, sizes array<int>, blocks array<struct<text:string,inside:boolean>>"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, key, html) to the page's host and blocks, some pages at a time; sizes are tokens of each block with its
    end, negative outside the marked article."""
    blocks = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.bool_())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            some = batch.slice(start, 256)
            pages = [read_page(h or "") for h in some["html"].to_pylist()]
            hosts = pa.array([host_of(u) for u in some["url"].to_pylist()], pa.string())
            said = pa.array([[{"text": t, "inside": i} for t, i in p.blocks] for p in pages], blocks)
            sizes = pa.array([[t.count(" ") + 2 if i else -t.count(" ") - 2 for t, i in p.blocks] for p in pages], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([some["page_id"], some["url"], hosts, some["key"], pa.array([p.marked for p in pages], pa.bool_()), sizes, said], ["page_id", "url", "host", "key", "marked", "sizes", "blocks"])


STREAM_ROWS = "host string, key string, marked boolean, tokens array<int>, sizes array<int>"


class TokenDigests(dict):
    """Digests of words, as many as MOST are remembered."""

    MOST = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh32_intdigest(word) >> 1 | 1
        return found


def stream_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, marked, sizes, blocks) to (host, key, marked, tokens, sizes): digests of words, 0 at block ends."""
    digests = TokenDigests()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            some, tokens, ends = batch.slice(start, 256), [], [0]
            counts = np.cumsum(np.append(0, some["blocks"].value_lengths().to_numpy()))
            for text in some["blocks"].flatten().field("text").to_pylist():
                tokens += map(digests.__getitem__, text.split(" "))
                tokens.append(0)
                ends.append(len(tokens))
            streams = pa.ListArray.from_arrays(pa.array(np.array(ends)[counts].astype("i4")), pa.array(np.array(tokens, "i4")))
            columns = [some["host"], some["key"], some["marked"], streams, some["sizes"]]
            yield pa.RecordBatch.from_arrays(columns, ["host", "key", "marked", "tokens", "sizes"])


def suffix_ranks(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling up to a power of two of tokens: order, and rank of each suffix's prefix."""
    rank, reach = np.unique(tokens, return_inverse=True)[1], 1
    while reach < length:
        ahead = np.concatenate((rank[reach:] + 1, np.zeros(min(reach, len(rank)), rank.dtype)))
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1]
        reach *= 2
    return np.argsort(rank, kind="stable"), rank


def site_pages(pages: int) -> int:
    """How many of a host's pages with articles must share a run there for it to be the site's."""
    return max(SITE_PAGES, int(np.ceil(pages * SITE_SHARE)))


def pages_sharing(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix, how many pages have a suffix of its rank."""
    order = np.lexsort((page, rank))
    first = np.ones(len(order), bool)
    first[1:] = (rank[order][1:] != rank[order][:-1]) | (page[order][1:] != page[order][:-1])
    groups, inverse = np.unique(rank, return_inverse=True)
    return np.bincount(inverse[order[first]], minlength=len(groups))[inverse]


def covered_by(hits: np.ndarray, size: int, run: int) -> np.ndarray:
    """Which of size tokens lie in runs that begin at hits."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + run, -1)
    return np.cumsum(edges)[:-1] > 0


def shared_runs(streams: list[np.ndarray], inside: list[np.ndarray], marked: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """For each page's stream, which tokens lie in boilerplate runs; inside tells tokens of a marked article."""
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    tokens = np.concatenate(streams) if streams else np.zeros(0, np.int64)
    within = np.concatenate(inside) if inside else np.zeros(0, bool)
    covered = np.zeros(len(tokens), bool)
    if len(tokens) >= run:
        rank = suffix_ranks(tokens, run)[1]
        at = np.flatnonzero(page[run - 1 :] == page[: len(tokens) - run + 1])
        depth = np.cumsum(np.concatenate(([0], within)))
        in_article = depth[at + run] - depth[at] == run
        shared, site = pages_sharing(rank[at], page[at]), np.zeros(len(at), np.int64)
        site[in_article] = pages_sharing(rank[at][in_article], page[at][in_article])
        open_ = ~marked[page[at]]
        hit = np.where(open_, shared > 1, site >= site_pages(int(marked.sum())))
        covered = covered_by(at[hit], len(tokens), run)
    return np.split(covered, np.cumsum([len(s) for s in streams])[:-1])


def kept_blocks(covered: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which blocks have a word that no run covers."""
    sizes = np.abs(sizes)
    ends = np.cumsum(sizes)
    free = np.concatenate(([0], np.cumsum(~covered)))
    return free[ends - 1] - free[ends - sizes] > 0


def host_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """One host's pages to the masks of kept blocks of those that lose some; equal pages are one."""
    rows = rows.drop_duplicates("key")
    sizes = [np.asarray(x, np.int64) for x in rows["sizes"]]
    found = shared_runs([np.asarray(t, np.int64) for t in rows["tokens"]], [np.repeat(x > 0, np.abs(x)) for x in sizes], rows["marked"].to_numpy(bool))
    kept = [kept_blocks(c, x) for c, x in zip(found, sizes)]
    out = [(h, k, m) for h, k, m in zip(rows["host"], rows["key"], kept) if not m.all()]
    return pd.DataFrame(out, columns=["host", "key", "kept"])


MULTIPLIERS = np.random.default_rng(20240808).integers(0, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, key, marked, tokens, sizes, frequent) to (host, key, marked, run, inside, places) for each run of a page: a
    digest within the host, whether it is an article's, and where. For hosts without open pages only runs of frequent tokens count."""
    for batch in batches:
        slices = lambda c: np.split(batch[c].flatten().to_numpy(zero_copy_only=False), np.cumsum(batch[c].value_lengths().fill_null(0).to_numpy())[:-1])
        often, is_null = slices("frequent"), batch["frequent"].is_null().to_pylist()
        for host, key, marked, tokens, sizes, frequent, all_count in zip(*(batch[c].to_pylist() for c in ("host", "key", "marked")), slices("tokens"), slices("sizes"), often, is_null):
            if len(tokens) < RUN:
                continue
            depth = np.cumsum(np.concatenate(([0], np.repeat(sizes > 0, np.abs(sizes)))))
            inside = depth[RUN:] - depth[:-RUN] == RUN
            places = np.arange(len(tokens) - RUN + 1)
            if not all_count:
                among = np.cumsum(np.concatenate(([0], np.isin(tokens, frequent))))
                places = np.flatnonzero(inside & (among[RUN:] - among[:-RUN] == RUN))
                if not len(places):
                    continue
            runs = np.lib.stride_tricks.sliding_window_view(tokens.astype(np.int64).view(np.uint64), RUN) @ MULTIPLIERS
            runs = ((runs ^ np.uint64(xxhash.xxh64_intdigest(host))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            places = places[np.lexsort((places, inside[places], runs[places]))]
            first = np.ones(len(places), bool)
            first[1:] = (runs[places][1:] != runs[places][:-1]) | (inside[places][1:] != inside[places][:-1])
            starts = np.flatnonzero(first)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(places)).astype("i4")), pa.array(places.astype("i4")))
            n, some = len(starts), places[starts]
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([key] * n, pa.string()), pa.array([marked] * n, pa.bool_()), pa.array(runs[some]), pa.array(inside[some]), lists], ["host", "key", "marked", "run", "inside", "places"])


def split_host_runs(streams: DataFrame, pages: DataFrame) -> DataFrame:
    """host, key, kept of pages of large hosts (with open, least): suffixes meet by the run they start with.

    A run that least pages share is made of tokens that least pages have: where no page is open, others are left out first. Of
    such tokens a host has few: at least half of its pages with articles have each. Equal pages, which pages has once, only
    add to these tokens; runs count pages by their keys.
    """
    tokens = streams.filter("open = 0").select("host", "least", F.explode(F.array_distinct("tokens")).alias("token"))
    often = tokens.groupBy("host", "least", "token").agg(F.count("*").alias("n")).filter("n >= least")
    often = stored(often.groupBy("host").agg(F.collect_set("token").alias("frequent")), "html-frequent")
    none = F.when(F.col("open") == 0, F.array().cast("array<int>"))
    rows = streams.join(often, "host", "left").withColumn("frequent", F.coalesce("frequent", none))
    rows = rows.select("host", "key", "marked", "tokens", "sizes", "frequent").mapInArrow(run_digests, "host string, key string, marked boolean, run long, inside boolean, places array<int>")
    rows = stored(rows, "html-runs", compression="zstd")
    on_page = rows.groupBy("run", F.xxhash64("key").alias("page")).agg(F.max("inside").alias("inside"))
    runs = on_page.groupBy("run").agg(F.count("*").alias("pages"), F.count_if("inside").alias("articles")).filter("pages > 1")
    hosts = streams.select("host", "least").distinct()
    hit = rows.join(stored(runs, "html-shared"), "run").join(hosts, "host")
    hit = hit.filter(~F.col("marked") | (F.col("inside") & (F.col("articles") >= F.col("least"))))
    places = hit.groupBy("host", "key").agg(F.flatten(F.collect_set("places")).alias("places"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.array(x) for x in batch["sizes"].to_pylist()]
            kept = [kept_blocks(covered_by(np.array(p), int(np.abs(x).sum()), RUN), x) for p, x in zip(batch["places"].to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["key"], pa.array([k.tolist() for k in kept], pa.list_(pa.bool_()))], ["host", "key", "kept"])

    found = places.join(pages, ["host", "key"]).select("host", "key", "places", "sizes")
    return found.mapInArrow(task, "host string, key string, kept array<boolean>").filter(~F.forall("kept", lambda k: k))


def boilerplate(rows: DataFrame, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """host, key, kept (which blocks stay) of distinct pages that lose blocks to shared runs."""
    rows = rows.select("host", "key", "marked", "sizes", "blocks")
    length = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, i: n + F.abs(i))
    pages = rows.groupBy("host", "key").agg(F.first("marked").alias("marked"), F.first("sizes").alias("sizes"), F.count("*").alias("rows"))
    pages = stored(pages, "html-pages", compression="zstd")
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.sum(length("sizes") * F.col("rows")).alias("n"), F.count_if("marked").alias("articles")).withColumn("open", F.col("pages") - F.col("articles"))
    hosts = stored(hosts.filter("pages > 1"), "html-hosts")
    some = rows.join(hosts.filter(F.col("n") <= host_tokens).select("host"), "host").select(rows.columns)
    kept = some.mapInArrow(stream_rows, STREAM_ROWS).groupBy("host").applyInPandas(host_runs, "host string, key string, kept array<boolean>")
    large = hosts.filter(F.col("n") > host_tokens)
    if not large.isEmpty():
        least = F.greatest(F.lit(SITE_PAGES), F.ceil(F.col("articles") * SITE_SHARE)).alias("least")
        large = large.select("host", "open", least)
        some = rows.join(large.select("host"), "host").select(rows.columns)
        kept = kept.unionByName(split_host_runs(some.mapInArrow(stream_rows, STREAM_ROWS).join(large, "host"), pages))
    return stored(kept, "html-kept")


def main_text(pages: DataFrame, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.md5(F.coalesce("html", F.lit(""))).alias("key"), "html")
    rows = stored(rows.mapInArrow(block_rows, BLOCK_ROWS), "html-blocks", compression="zstd")
    rows = rows.join(boilerplate(rows, host_tokens), ["host", "key"], "left")
    stays = lambda b, i: (b["inside"] | ~F.col("marked")) & (F.col("kept").isNull() | F.get("kept", i))
    text = F.array_join(F.transform(F.filter("blocks", stays), lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8}
SQL: dict[str, str] = {}
