"""Main text of web pages: structure first, then a suffix array over each host.

Every page is cut into blocks. Blocks under elements that never hold article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, comments) are chrome; paragraphs under an article or main element are article text; all others
are undecided. What is outside an article, main or content element goes only if those of its rank and above hold most of the text.

Where a host has undecided blocks, the token streams of chrome and undecided blocks of its pages are concatenated into a suffix
array: all suffixes, range-partitioned and sorted by host and by their first ``DEPTH`` tokens. Neighbours whose longest common
prefix reaches ``DEPTH`` tokens, and that are of distinct pages, cover these tokens; a longer repeat is a chain of such suffixes, and
a repeat of fewer tokens is not told from chance. Covered tokens of undecided blocks are boilerplate and are cut out;
unique runs stay. Pages with the same stream are one page: the copies of a page are no boilerplate of each other.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.llm import shingles
from gridfold.llm.common import materialise

DEPTH = 8

# Each pattern is linear in what it reads. A tag with an open quote, or without an end, is found so once in a page: the tags after it
# are read by the simple form, which ends at the next angle bracket.
_SPECIAL = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
_TAG = re.compile(_SPECIAL + r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_SIMPLE_TAG = re.compile(_SPECIAL + r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# The element names of HTML by what they are to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption article main".split())
CHROME = frozenset("head nav footer aside form button select optgroup option menu dialog noscript template svg canvas object audio video map search".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "adsbygoogle outbrain taboola footer cookie cookies consent gdpr notice popup modal overlay subscribe subscription newsletter signup login "
    "comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social widget pagination pager toolbar paywall".split()
)
#: Chrome words that no heading or section is named by, and the words that make up names of chrome with others of ``CHROME_WORDS``.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement adsbygoogle outbrain taboola disqus commentlist sidebar navbar breadcrumb breadcrumbs newsletter".split())
FORM_WORDS = frozenset("posts articles stories button buttons icon icons bar tools slot unit form count prompt cta thread site page primary secondary inline sticky div gpt dfp google".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies".split())
NOT_ITSELF = frozenset("has with no without layout template theme grid columns".split())
WRAPPERS = frozenset("wrapper wrap container box block section area inner outer list item items holder panel region group row col column left right top bottom desktop mobile text link links".split())
CONTENT_WORDS = frozenset("article content post entry story main".split())
CHROME_NAMES = CHROME_WORDS | FORM_WORDS | HEADER_WORDS | WRAPPERS | CONTENT_WORDS
CLOSES_PARAGRAPH = BLOCK - frozenset("caption legend option optgroup summary tbody td tfoot th thead tr html head body button dd dt li".split())
LIKE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table select article main section div body html aside nav form header footer".split())

SURE, UNDECIDED, REMOVED = 0, 1, 2


def _kind(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool, bool]:
    """Whether an element is chrome, is named like the page's content, and is a header (which in an article is its own). A name
    is told by its first and its last word that is not of a wrapper: "post-footer" and "site-nav-box" are chrome, "has-sidebar" says nothing of itself. Inside an article or main element, where names are
often made from headings, all words must be of chrome: "related-posts" is, "related-work" is not."""
    chrome, content, header = tag in CHROME, False, tag == "header"
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                chrome = True
            elif name == "role":
                chrome, content = chrome or value.lower() in CHROME_ROLES, content or value.lower() in ("main", "article")
            elif name in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in _WORD.findall(_CAMEL.sub(" ", token))]
                    if not words or words[0] in NOT_ITSELF:
                        continue
                    while len(words) > 1 and words[-1] in WRAPPERS:
                        words.pop()
                    ends = {words[0], words[-1]}
                    named = not ends.isdisjoint(COMMENT_WORDS if tag in ("main", "article") else CHROME_WORDS)
                    if named and inside and (name == "id" or ends.isdisjoint(ADVERT_WORDS)):
                        named = all(len(w) == 1 or w in CHROME_NAMES for w in words)
                    chrome = chrome or named
                    header = header or not ends.isdisjoint(HEADER_WORDS)
                    content = content or not ends.isdisjoint(CONTENT_WORDS)
    return chrome, content, header


class _Stack:
    """The open elements. Closing one takes the time of the elements that it closes."""

    def __init__(self) -> None:
        self.items = [("", False, 0, 0, 0)]  # element, chrome, container, places of the innermost block and scope
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, chrome: bool, container: int) -> None:
        at, (*_, block, scope) = len(self.items), self.items[-1]
        self.items.append((tag, chrome, container, at if tag in BLOCK else block, at if tag in SCOPE else scope))
        self.places[tag].append(at)

    def close(self, names: tuple[str, ...], within: frozenset[str] | None = None) -> None:
        """Close the innermost element of these names, unless an element of ``within`` (BLOCK or SCOPE) is inside it."""
        at = max((self.places[n][-1] for n in names if self.places[n]), default=0)
        if at and (within is None or self.items[-1][3 if within is BLOCK else 4] <= at):
            while len(self.items) > at:
                self.places[self.items.pop()[0]].pop()


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order, as text and SURE, UNDECIDED or REMOVED."""
    page = page or ""
    found: list[tuple[str, bool, int, bool]] = []  # text, chrome, container (3 article, 2 main, 1 content, 0 none), paragraph
    stack = _Stack()
    parts: list[str] = []
    at, end, form = 0, len(page), _TAG

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, chrome, container, block, _ = stack.items[-1]
                found.append((text, chrome, container, stack.items[block][0] in PARAGRAPH))

    while at < end:
        begin = page.find("<", at)
        m = form.match(page, begin) if begin >= 0 else None
        if m is None:
            if begin < 0:
                parts.append(page[at:])
                break
            if form is _TAG and _OPENS.match(page, begin):
                form = _SIMPLE_TAG
                continue
            parts.append(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            parts.append(page[at:begin])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
                stack.close((tag,))
            elif tag not in VOID:
                stack.close((tag,), BLOCK)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^<>]*+>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_PARAGRAPH:
                stack.close(("p",), SCOPE)
            if tag in LIKE:
                stack.close(LIKE[tag], SCOPE)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        _, above, container, *_ = stack.items[-1]
        chrome, content, header = _kind(tag, m[3], container >= 2)
        chrome = chrome or header and container < 2 and tag not in ("main", "article")
        stack.push(tag, above or chrome, max(container, 3 if tag == "article" else 2 if tag == "main" else int(content)))
    flush()
    held = [sum(len(t) for t, chrome, c, _ in found if not chrome and c >= rank) for rank in range(4)]
    least = next((rank for rank in (3, 2, 1) if 2 * held[rank] > held[0]), 0)
    return [(t, REMOVED if chrome or c < least else SURE if c >= 2 and paragraph else UNDECIDED) for t, chrome, c, paragraph in found]


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int32()), ("first", pa.int32())]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's article text if nothing is undecided, else null; its other blocks (all, if something is undecided), with the place of
    their first token in the page."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            part = batch.slice(begin, 512)
            texts, others = [], []
            for page in part.column(0):
                cut = blocks(page.as_py())
                loose = any(k == UNDECIDED for _, k in cut)
                texts.append(None if loose else "\n\n".join(t for t, k in cut if k == SURE))
                first = np.cumsum([0, *(len(t.split()) for t, _ in cut)])[:-1].tolist()
                others.append([{"text": t, "kind": k, "first": at} for (t, k), at in zip(cut, first, strict=True) if loose or k != SURE])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(others, _BLOCKS), *part.columns[1:]], names=["text", "blocks", *part.schema.names[1:]])


_SUFFIX = pa.schema([("host", pa.int64()), ("prefix", pa.binary()), ("page", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("near", pa.bool_())])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each page's stream by their first ``DEPTH`` tokens (32 bits of each), ``at`` their place in the page; ``near`` if
    one of these tokens is of an undecided block. Article text interrupts the stream; pages are told by a hash of it."""
    for batch in batches:
        for host, row, cut in zip(*(batch.column(c) for c in ("host", "row", "blocks")), strict=True):
            runs: list[tuple[int, list[bytes], list[bool]]] = []
            end = -1
            for b in cut.as_py() or []:
                if b["kind"] == SURE:
                    continue
                own = b["text"].encode().split()
                if b["first"] != end or not runs:
                    runs.append((b["first"], [], []))
                runs[-1][1].extend(own)
                runs[-1][2].extend([b["kind"] == UNDECIDED] * len(own))
                end = b["first"] + len(own)
            page = xxhash.xxh64(b"\n".join(b" ".join(w) for _, w, _ in runs)).intdigest() - (1 << 63)
            for first, words, loose in runs:
                if (n := len(words) - DEPTH + 1) > 0:
                    hashes, _ = shingles.word_hashes([b" ".join(words)])
                    low = (hashes >> np.uint64(32)).astype(">u4")
                    prefix = np.lib.stride_tricks.sliding_window_view(low, DEPTH).tobytes()
                    until = np.cumsum([0, *loose])
                    prefixes = pa.Array.from_buffers(pa.binary(4 * DEPTH), n, [None, pa.py_buffer(prefix)]).cast(pa.binary())
                    same = lambda x, n=n: pa.array(np.full(n, x, np.int64))
                    yield pa.RecordBatch.from_arrays([same(host.as_py()), prefixes, same(page), same(row.as_py()), pa.array((first + np.arange(n)).astype(np.int32)), pa.array(until[DEPTH:] > until[:-DEPTH])], schema=_SUFFIX)


_FOUND = pa.schema([("host", pa.int64()), ("prefix", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (row, at) of suffixes near undecided text that share their ``DEPTH`` tokens with a neighbour of another page.

    The runs at both ends of a partition may go on in the next: their key is given with them (with the least and largest page,
    once also without a row), and what no neighbour here covers is given too, to be decided by all partitions that have the key.
    """

    def out(rows: np.ndarray, ats: np.ndarray, key: tuple | None = None, low: int = 0, high: int = 0) -> pa.RecordBatch:
        n = len(rows)
        host, prefix = (key if key else (None, None))
        both = [pa.array([x] * n, pa.int64()) for x in ((low, high) if key else (None, None))]
        return pa.RecordBatch.from_arrays([pa.array([host] * n, pa.int64()), pa.array([prefix] * n, pa.binary()), *both, pa.array(rows, pa.int64()), pa.array(ats, pa.int32())], schema=_FOUND)

    key, low, high, held, edge = None, 0, 0, [], True  # the run at hand: held are its (row, at) that no neighbour covers so far

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        if key is not None and (edge or last):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, low, high, None, None), _FOUND, strict=True)], schema=_FOUND)
            for rows, ats in held:
                yield out(rows, ats, key, low, high)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        host, page, row, at = (batch.column(c).to_numpy() for c in ("host", "page", "row", "at"))
        prefix, near = np.array(batch.column("prefix").to_pylist(), f"S{4 * DEPTH}"), batch.column("near").to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (host[1:] != host[:-1]) | (prefix[1:] != prefix[:-1])
        starts = np.append(np.flatnonzero(new), n)
        lows, highs = np.minimum.reduceat(page, starts[:-1]), np.maximum.reduceat(page, starts[:-1])
        for k in sorted({0, len(starts) - 2}):  # the first and the last run of the batch
            a, b = starts[k], starts[k + 1]
            own = (int(host[a]), batch.column("prefix")[int(a)].as_py())
            if own != key:
                yield from close(False)
                edge = key is None
                key, low, high, held = own, int(lows[k]), int(highs[k]), []
            low, high = min(low, int(lows[k])), max(high, int(highs[k]))
            mine = a + np.flatnonzero(near[a:b])
            held.append((row[mine], at[mine]))
            if low != high:
                for rows, ats in held:
                    yield out(rows, ats)
                held = []
            if k == 0 and len(starts) > 3:
                inner = near & np.repeat(lows != highs, np.diff(starts))
                inner[: starts[1]] = inner[starts[-2] :] = False
                yield out(row[inner], at[inner])
    yield from close(True)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of pages without the covered tokens of undecided ones."""
    for batch in batches:
        texts = []
        for own, starts in zip(batch.column("blocks"), batch.column("starts"), strict=True):
            kept, own = [], own.as_py()
            covered = np.zeros(own[-1]["first"] + len(own[-1]["text"].split()) + DEPTH, bool)
            for at in starts.as_py() or []:
                covered[at : at + DEPTH] = True
            for b in own:
                if b["kind"] == SURE:
                    kept.append(b["text"])
                elif b["kind"] == UNDECIDED and (left := " ".join(w for i, w in enumerate(b["text"].split(), b["first"]) if not covered[i])):
                    kept.append(left)
            texts.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` for each page: the article's blocks in page order, joined by a blank line.

    Character references are decoded and white space inside a block becomes one space. A page without article text, or with a
    null html, has the empty text. Pages without a host in their url are one host. Repeated rows of a page, and pages with the
    same text, count as one page when repeats are looked for. Pages of any length are read as a whole. An empty table gives none.
    """
    of_host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1), F.lit("")))
    own = pages.select(F.col(html_col).alias("html"), F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("key"), F.xxhash64(of_host).alias("host"))
    key_type = own.schema["key"].dataType.simpleString()
    cut = own.mapInArrow(_parsed, f"text string, blocks array<struct<text:string,kind:int,first:int>>, key {key_type}, host long")
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()), "pages")
    text = cut.filter(F.col("text").isNotNull()).select("key", "text")
    loose = cut.filter(F.col("text").isNull())
    if not loose.isEmpty():
        of_these = cut.join(loose.select("host").distinct(), "host", "left_semi").select("host", "row", "blocks")
        array = of_these.mapInArrow(_suffixes, "host long, prefix binary, page long, row long, at int, near boolean")
        array = array.repartitionByRange("host", "prefix", "page").sortWithinPartitions("host", "prefix", "page")
        found = materialise(array.mapInArrow(_neighbours, "host long, prefix binary, low long, high long, row long, at int"), "repeats")
        at_edges = found.filter(F.col("prefix").isNotNull()).groupBy("host", "prefix").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("host", "prefix")
        late = found.filter(F.col("prefix").isNotNull() & F.col("row").isNotNull()).join(at_edges, ["host", "prefix"], "left_semi")
        covered = found.filter(F.col("prefix").isNull()).union(late.select(found.columns)).groupBy("row").agg(F.collect_set("at").alias("starts"))
        ends = loose.select("row", "key", "blocks").join(covered, "row", "left").select("key", "blocks", "starts")
        text = text.union(ends.mapInArrow(_cut_out, f"key {key_type}, text string"))
    return text.select(F.col("key.id").alias(id_col), F.col("key.url").alias(url_col), "text")
