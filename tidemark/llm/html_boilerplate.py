"""Main text of web pages: page structure, and a suffix array over each host's token streams.

A page is cut into blocks. Markup tells what a block is: `main` inside an article or main element, `chrome` inside
menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden elements, `open` elsewhere, `heading` for
an open heading of the first level. A page with a main block keeps its main blocks and headings; one without keeps its
open blocks and headings.

The blocks of a host's pages, all of them, are concatenated as tokens and sorted as suffixes, by prefix doubling up to
RUN tokens. A run of RUN tokens or more that stands on enough distinct pages of the host is boilerplate: blocks lose the
tokens it covers and keep their unique runs. In open blocks, where markup says nothing, enough is MIN_PAGES, or the logarithm
to base 2 of the host's distinct pages if that is more. What markup calls the article may be quoted by other pages; main
blocks lose what stands, besides, outside chrome on more than half of the host's distinct pages.

Copies don't erase each other: pages with the same text outside chrome are one page, and a page of whose text less than
1 / OWN_PART is its own, in no run of another page of the host, is a near copy; near copies that hold a run count as one
page for it. So boilerplate stays on a host whose pages are nearly all near copies.

A host's pages are sorted in shards of about SHARD_PAGES pages or SHARD_BYTES, dealt by a hash of the page, which bounds a task
however large a host is. A host of several shards is judged as a whole all the same: its shards exchange 64-bit hashes of
their runs, first with the distinct pages that hold each, to tell which runs two pages share and so which pages are near
copies, then, of the shared runs, with the pages that count. Equal texts count in the shard of the smallest number.

A null html is empty, its text is the empty string. A null or odd url is a host of its own name. A null id passes
through, and rows that repeat a page are copies. Columns besides id, url and html are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import stored
from tidemark.llm._words import rolling, texts, words

RUN = 8
MIN_PAGES = 3
OWN_PART = 5
SHARD_PAGES = 2048
SHARD_BYTES = 64 << 20
MAIN, OPEN, CHROME, HEADING = 0, 1, 2, 3

# HTML's elements by their role, and the names that sites give to parts that aren't the article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul head legend".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form menu head dialog button select search fieldset object video audio canvas title".split())
MAIN_ELEMENTS = frozenset("article main".split())
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar menu nav navbar navigation breadcrumb"
    " breadcrumbs footer cookie cookies consent gdpr notice notices comment comments discussion disqus reply replies share sharing social related"
    " recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip toc".split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

_RAW = "script|style|noscript|template|svg|math|iframe|textarea|xmp|noembed"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _part(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is chrome, and whether it is main content."""
    if tag in DROPPED or tag == "header" and not in_main:
        return True, False
    main = tag in MAIN_ELEMENTS
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                found = {w.lower() for w in _NAME.findall(value)}
                if found & PART_NAMES and tag not in ("html", "body") or found & HEADER_NAMES and not in_main:
                    return True, False
            elif name == "role":
                if value.lower() in ROLES or value.lower() == "banner" and not in_main:
                    return True, False
                main |= value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
            elif name == "itemprop":
                main |= value.lower() == "articlebody"
    return False, main


def blocks(html: str) -> list[tuple[int, str]]:
    """The (kind, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, kind of what is inside, whether a first-level heading
    kind, heading, at = OPEN, False, 0

    def close() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            out.append((HEADING if heading and kind == OPEN else kind, text))
        pieces.clear()

    for m in _TAG.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            pieces.append(unescape(text) if "&" in text else text)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if not block and tag == "br":
            pieces.append(" ")
        if block:
            close()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] != kind:
                        close()
                    del stack[i:]
                    break
        elif tag in VOID:
            continue
        else:
            if tag == "body":
                stack.clear()
            if block and stack and stack[-1][0] == "p":
                stack.pop()
            inside = stack[-1][1] if stack else OPEN
            chrome, main = (False, False) if inside == CHROME else _part(tag, m[4], inside == MAIN)
            if block or chrome or main:
                if chrome or main:
                    close()
                own = CHROME if chrome else MAIN if main and inside != CHROME else inside
                stack.append((tag, own, tag == "h1" or bool(stack) and stack[-1][2]))
        kind, heading = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
    text = html[at:]
    pieces.append(unescape(text) if "&" in text else text)
    close()
    return out


def parse(pages: DataFrame) -> DataFrame:
    """The columns but html, the blocks' texts joined by line feeds, their kinds, a byte each, and a hash of the text outside chrome."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [blocks(x.as_py() or "") for x in part.column("html")]
                text, kinds = ["\n".join(t for _, t in f) for f in found], [bytes(k for k, _ in f) for f in found]
                own = [blake2b(" ".join(t for k, t in f if k != CHROME).encode(), digest_size=8).digest() for f in found]
                key = pa.array(np.frombuffer(b"".join(own), np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(text), pa.array(kinds, pa.binary()), key], [*kept, "blocks", "kinds", "key"])

    kept = [c for c in pages.columns if c != "html"]
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in kept)
    return pages.mapInArrow(run, f"{schema}, blocks string, kinds binary, key long")


def host(url):
    """The host of a url, in lower case; of an odd url all of it."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), url, F.lit("")))


def suffix_order(token: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a token sequence in order of their first `depth` tokens (a power of two), and the rank of each.

    Prefix doubling; a suffix stops at the end of its page. Suffixes with equal first tokens have equal ranks.
    """
    rank = np.unique(token, return_inverse=True)[1].astype(np.int64) + 1
    order, span = np.argsort(rank, kind="stable"), 1
    while span < depth:
        at = np.arange(len(token)) + span
        later = np.where(at < end, rank[np.minimum(at, len(token) - 1)], 0)
        key = rank * (len(token) + 2) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(len(token), np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        span *= 2
    return order, rank


class Shard(NamedTuple):
    """Tokens of some pages of a host and their runs, the sequences of RUN tokens within a page."""

    page: np.ndarray  # of each token
    block: np.ndarray  # of each token, within its page
    kind: np.ndarray  # of each token's block
    run: np.ndarray  # number of the run that starts at each token, -1 for none
    held: tuple[np.ndarray, np.ndarray]  # the distinct (run, page)
    clear: np.ndarray  # of each of these, whether the run stands outside chrome there
    hashes: np.ndarray  # of each run, 64 bits
    pages: int

    @property
    def runs(self) -> int:
        return len(self.hashes)

    def count(self, chosen: np.ndarray, clear: bool = False) -> np.ndarray:
        """On how many of the chosen pages each run stands, or stands outside chrome."""
        return np.bincount(self.held[0][chosen[self.held[1]] & (self.clear | (not clear))], minlength=self.runs)

    def covered(self, chosen: np.ndarray) -> np.ndarray:
        """The tokens that the chosen runs cover."""
        start = np.flatnonzero((self.run >= 0) & np.append(chosen, False)[self.run])
        step = np.zeros(len(self.page) + RUN + 1, np.int64)
        step[start] += 1
        step[start + RUN] -= 1
        return np.cumsum(step)[: len(self.page)] > 0

    def fresh(self, shared: np.ndarray) -> np.ndarray:
        """The pages that aren't near copies, given the runs that stand on two distinct pages of the host."""
        inside = self.kind != CHROME
        total = np.bincount(self.page[inside], minlength=self.pages)
        own = np.bincount(self.page[inside & ~self.covered(shared)], minlength=self.pages)
        return (total > 0) & (own * OWN_PART >= total)


def shard_of(raw: np.ndarray, edges: np.ndarray, kinds: list[np.ndarray], sort: bool = True) -> Shard:
    """The runs of a shard, told apart by its suffix array; without `sort` by their hashes, where these have been exchanged."""
    pages = len(edges) - 1
    page, begin, _, token = words(raw, edges)
    line = np.concatenate(([0], np.cumsum(raw == 10)))
    block = line[begin] - line[edges[page]]
    run, none = np.full(len(page), -1), np.zeros(0, np.int64)
    if not len(page):
        return Shard(page, block, none, run, (none, none), none > 0, none, pages)
    first_block = np.cumsum([0, *map(len, kinds)])
    kind = np.concatenate(kinds)[first_block[page] + block]
    edge = np.searchsorted(page, np.arange(len(edges)))
    whole = np.arange(len(page)) + RUN <= edge[page + 1]
    if not whole.any():
        return Shard(page, block, kind, run, (none, none), none > 0, none, pages)
    rolled = rolling(token, RUN).view(np.int64)
    if sort:
        order, rank = suffix_order(token, edge[page + 1], RUN)
        order = order[whole[order]]
        first = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
        group, hashes = np.cumsum(first) - 1, rolled[order[first]]
    else:
        order = np.flatnonzero(whole)
        hashes, group = np.unique(rolled[order], return_inverse=True)
    run[order] = group
    pair, at = np.unique(group * pages + page[order], return_inverse=True)
    chrome = np.cumsum(np.concatenate(([0], kind == CHROME)))
    clear = np.zeros(len(pair), bool)
    clear[at[chrome[order + RUN] == chrome[order]]] = True
    return Shard(page, block, kind, run, (pair // pages, pair % pages), clear, hashes, pages)


def first_of(key: np.ndarray) -> np.ndarray:
    """The first page of each text."""
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    return first


def least_pages(pages: int) -> int:
    """The distinct pages that make a run boilerplate, on a host of so many."""
    return max(MIN_PAGES, (pages - 1).bit_length())


def boilerplate_runs(on: np.ndarray, clear: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether open and whether main blocks lose the runs that stand on so many of a host's distinct pages, on so many outside chrome."""
    return on >= least_pages(pages), (clear >= least_pages(pages)) & (2 * clear > pages)


def gone(shard: Shard, from_open: np.ndarray, from_main: np.ndarray) -> np.ndarray:
    """The tokens that blocks lose."""
    return shard.covered(from_open) & (shard.kind == OPEN) | shard.covered(from_main) & (shard.kind == MAIN)


def votes(shard: Shard, first: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct pages but near copies hold each run, and hold it outside chrome, then whether near copies do; and
    both of all pages. The `first` of each text counts."""
    fresh = shard.fresh(shared)
    held = np.array([shard.count(first & fresh), shard.count(first & fresh, True), shard.count(~fresh) > 0, shard.count(~fresh, True) > 0], np.int64)
    return held, np.array([(first & fresh).sum(), (~fresh).any()], np.int64)


def judged(held: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether open and whether main blocks lose runs, by the sums of a host's votes."""
    return boilerplate_runs(held[0] + (held[2] > 0), held[1] + (held[3] > 0), int(pages[0] + (pages[1] > 0)))


def _shard(table: pa.Table, sort: bool = True) -> tuple[Shard, list[np.ndarray]]:
    kinds = [np.frombuffer(k.as_buffer(), np.uint8) if k.is_valid else np.zeros(0, np.uint8) for k in table["kinds"]]
    return shard_of(*texts(table["blocks"]), kinds, sort), kinds


def _told(news: pa.Table, what: int) -> np.ndarray:
    """All numbers that a shard was told under a heading."""
    found = [x.values.to_numpy() for x, w in zip(news["numbers"], news["what"].to_pylist()) if w == what]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _numbers(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.LargeListArray.from_arrays(ends, np.concatenate([*rows, np.zeros(0, np.int64)])).cast(pa.list_(pa.int64()))


def _packed(rows: Iterable[np.ndarray]) -> pa.Array:
    """64-bit numbers, all first bytes before all second ones, as those of ascending numbers or small counts compress."""
    return pa.array([np.ascontiguousarray(r, ">i8").view(np.uint8).reshape(-1, 8).T.tobytes() for r in rows], pa.binary())


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(">i8").ravel().astype(np.int64) for x in column]


TEXTS, SHARED, FROM_OPEN, FROM_MAIN = 0, 1, 2, 3
_NEWS = "host string, shard int, what int, numbers array<bigint>"
_SENT = "host string, shard int, bucket int, hashes binary, counts binary, pages binary"


def _dealt(table: pa.Table, shard: Shard, chosen: np.ndarray, counts: np.ndarray, pages: np.ndarray) -> pa.Table:
    """The chosen runs of a shard with their counts, a row a bucket; every bucket of the host gets one."""
    host, number, buckets = table["host"][0].as_py(), table["shard"][0].as_py(), table["shards"][0].as_py()
    order = np.argsort(shard.hashes[chosen])
    chosen, counts = chosen[order], counts[:, order]
    bucket = shard.hashes[chosen].view(np.uint64) % np.uint64(buckets)
    at = [np.flatnonzero(bucket == k) for k in range(buckets)]
    return pa.table({
        "host": [host] * buckets, "shard": pa.array([number] * buckets, pa.int32()), "bucket": pa.array(range(buckets), pa.int32()),
        "hashes": _packed(shard.hashes[chosen[a]] for a in at), "counts": _packed(counts[:, a].reshape(-1) for a in at), "pages": _packed([pages] * buckets),
    })


def _hold(table: pa.Table, news: pa.Table) -> pa.Table:
    """The runs of a shard with the number of distinct pages, of the texts that count here."""
    if not table.num_rows:
        return pa.table({"host": pa.array([], pa.string()), "shard": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "hashes": _packed([]), "counts": _packed([]), "pages": _packed([])})
    shard, key = _shard(table)[0], table["key"].to_numpy()
    return _dealt(table, shard, np.arange(shard.runs), shard.count(first_of(key) & np.isin(key, _told(news, TEXTS)))[None], np.zeros(0, np.int64))


def _vote(table: pa.Table, news: pa.Table) -> pa.Table:
    """The shared runs of a shard with its votes."""
    if not table.num_rows:
        return _hold(table, news)
    shard, key = _shard(table, sort=False)[0], table["key"].to_numpy()
    shared = np.isin(shard.hashes, _told(news, SHARED))
    held, pages = votes(shard, first_of(key) & np.isin(key, _told(news, TEXTS)), shared)
    return _dealt(table, shard, np.flatnonzero(shared), held[:, shared], pages)


def _summed(table: pa.Table, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Where each shard's hashes are among a bucket's distinct ones, the sums of their counts, and of the pages."""
    hashes = _unpacked(table["hashes"])
    at = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    counts = np.concatenate([x.reshape(width, -1) for x in _unpacked(table["counts"])], axis=1)
    total = np.array([np.bincount(at, c, int(at.max(initial=-1)) + 1) for c in counts]).astype(np.int64)
    return np.split(at, np.cumsum([len(h) for h in hashes])[:-1]), total, np.sum(_unpacked(table["pages"]), axis=0)


def _news(table: pa.Table, verdicts: dict[int, np.ndarray], at: list[np.ndarray]) -> pa.Table:
    """To each shard, those of its runs that a verdict holds for."""
    n = len(at) * len(verdicts)
    return pa.table({
        "host": [table["host"][0].as_py()] * n, "shard": pa.array(table["shard"].to_pylist() * len(verdicts), pa.int32()), "what": pa.array([w for w in verdicts for _ in at], pa.int32()),
        "numbers": _numbers([h[v[a]] for v in verdicts.values() for h, a in zip(_unpacked(table["hashes"]), at)]),
    })


def _share(table: pa.Table) -> pa.Table:
    at, total, _ = _summed(table, 1)
    return _news(table, {SHARED: total[0] > 1}, at)


def _judge(table: pa.Table) -> pa.Table:
    at, total, pages = _summed(table, 4)
    from_open, from_main = judged(total, pages)
    return _news(table, {FROM_OPEN: from_open, FROM_MAIN: from_main}, at)


def _extract(table: pa.Table, news: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    alone = table["shards"][0].as_py() == 1
    shard, kinds = _shard(table, sort=alone)
    if alone:
        first = first_of(table["key"].to_numpy())
        verdict = judged(*votes(shard, first, shard.count(first) > 1))
    else:
        verdict = np.isin(shard.hashes, _told(news, FROM_OPEN)), np.isin(shard.hashes, _told(news, FROM_MAIN))
    page, block, lost_tokens = shard.page, shard.block, gone(shard, *verdict)
    lost: dict[tuple[int, int], list[int]] = {}
    first = np.searchsorted(page * (1 << 32) + block, page * (1 << 32) + block)  # of each token's block
    for i in np.flatnonzero(lost_tokens).tolist():
        lost.setdefault((int(page[i]), int(block[i])), []).append(i - int(first[i]))
    out = []
    for p, (text, kind) in enumerate(zip(table["blocks"], kinds)):
        keep = MAIN if (kind == MAIN).any() else OPEN
        lines = []
        for b, (line, k) in enumerate(zip(text.as_py().split("\n"), kind)):
            if k not in (keep, HEADING):
                continue
            if (p, b) in lost:
                parts = line.encode().split()
                for i in lost[p, b]:
                    parts[i] = b""
                line = b" ".join(filter(None, parts)).decode()
            if line:
                lines.append(line)
        out.append("\n".join(lines))
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(out, pa.string())})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    size = pages.select(host(F.col(url_col)).alias("host"), F.octet_length(html_col).cast("long").alias("bytes")).groupBy("host").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    size = size.select("host", F.ceil(F.greatest(F.col("n") / SHARD_PAGES, F.col("bytes") / SHARD_BYTES)).cast("int").alias("shards"))
    large = stored(size.where("shards > 1"), "large-hosts")
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    dealt = chosen.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))  # Spark broadcasts `large` if its files are small
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), "shards").cast("int"))

    parsed, several, by = parse(dealt), parse(dealt.where("shards > 1").withColumn("url", F.lit(""))), ("host", "shard")
    owned = several.groupBy("host", "key").agg(F.min("shard").alias("shard")).select(*by, F.lit(TEXTS).alias("what"), F.array("key").alias("numbers"))

    # toDF gives the news columns of their own, where both sides come from the same pages
    def told(shards: DataFrame, news: DataFrame, f, schema: str) -> DataFrame:
        return shards.groupBy(*by).cogroup(news.toDF(*news.columns).groupBy(*by)).applyInArrow(f, schema)

    held = told(several, owned, _hold, _SENT)
    shared = stored(held.groupBy("host", "bucket").applyInArrow(_share, _NEWS), "shared-runs")
    voted = told(several, owned.unionByName(shared), _vote, _SENT)
    verdicts = stored(voted.groupBy("host", "bucket").applyInArrow(_judge, _NEWS), "boilerplate-runs")
    return told(parsed, verdicts, _extract, "page_id long, url string, text string")
