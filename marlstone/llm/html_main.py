"""Main text of web pages: removal of subtrees that recur across a host's pages, with structural rules besides."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, hot_keys, spread_join, stored

#: A subtree is template where it is on so many differing pages of a host, and on so large a share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: On so many differing pages of a host it is template whatever the share: large hosts have many sections, each with its own menus.
MANY_PAGES = 25
#: List items, and running text within marked main text, are template on so large a share of a host's pages only.
RUNNING_SHARE = 0.5
#: Template subtrees, of 16 bytes each, that may go to every task; more are dealt to the pages by a join.
SHARED_TEMPLATES = 1 << 20
#: Bytes of pages that are parsed before their rows go out.
SLICE_BYTES = 4 << 20

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("script style noscript template iframe select textarea option svg canvas object embed audio video map head title".split())
BOILERPLATE = frozenset("nav header footer aside form button dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing social related recommended pagination pager widget copyright legal disclaimer skip".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
LIST_PARTS = frozenset("ul ol dl table".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: One attribute after another from the start, so that nothing inside a value is taken for one.
_attribute = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_words = re.compile(r"[a-z]+")


def attributes_of(source: str) -> dict[str, str]:
    """An element's attributes by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _attribute.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower())
    return out


def is_boilerplate(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    """Whether an element is not main text by its name or role, or hidden. An article's own header is."""
    if tag in BOILERPLATE and not (tag == "header" and in_main):
        return True
    if tag in ("html", "body", "main"):
        return False
    return attributes.get("role") in BOILERPLATE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"


def is_classed(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a whole token of an element's class or id names boilerplate, in all its words: `cookie-notice`, but not `no-sidebar`."""
    if tag in ("html", "body", "article", "main"):
        return False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = _words.findall(token)
        if words and BOILERPLATE_WORDS.issuperset(words):
            return True
    return False


class Node:
    """An open element: its digest so far, its first block, and whether it is unseen, boilerplate or main text.

    One that is `classed` is boilerplate by its class unless it `holds` an article, main or h1. Text of an inline one
    that goes, as far as it is not yet in a block, begins at `mark`.
    """

    __slots__ = ("tag", "digest", "first", "unseen", "ruled", "main", "classed", "holds", "mark")

    def __init__(self, tag: str, first: int, unseen: bool, ruled: bool, main: bool, classed: bool = False, mark: int | None = None):
        self.tag, self.first, self.unseen, self.ruled, self.main = tag, first, unseen, ruled, main
        self.classed, self.holds, self.mark = classed, tag == "h1", mark
        self.digest = hashlib.blake2b(tag.encode(), digest_size=8)


class Page:
    """Blocks of text in page order, and the subtrees as ranges of blocks.

    `blocks` are texts; `ruled` tells which of them a structural rule removes: an element's name, role or class. An
    element never goes by its class or id if it is or holds an article, main or h1. Scripts, styles and their like
    have no text. `subtrees` are (first block, end, hash) of every element but inline ones and the whole page, in
    boilerplate too. A hash's lowest bit tells list items, and running text within article or main: copies and
    quotations recur there rightly, so these are template on a high share of the pages only.
    """

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.ranges: list[tuple[int, int]] = []  # of blocks that a rule removes
        self.stack = [Node("", 0, False, False, False)]
        self.opened: Counter[str] = Counter()
        self.foreign = self.classed = 0
        self.marked: list[Node] = []  # open inline elements that go
        self.text: list[str] = []
        at = 0
        while m := _token.search(source, at):
            self.data(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if m[1]:
                self.close(tag)
            elif tag:
                self.open(tag, m[3])
                if tag in RAW and self.stack[-1].tag == tag and not (m[3].endswith("/") and self.foreign):
                    # Text up to the element's own end tag, or to the end of the page; no other markup counts in it.
                    end = _raw_end[tag].search(source, at)
                    stop = end.start() if end else len(source)
                    self.data(source[at:stop])
                    at = stop
        self.data(source[at:])
        while len(self.stack) > 1:
            self.pop()
        self.flush()
        self.ruled = self.covered(self.ranges)

    def covered(self, ranges: list[tuple[int, int]]) -> list[bool]:
        """Which blocks lie in one of these ranges."""
        change = [0] * (len(self.blocks) + 1)
        for first, end in ranges:
            change[first] += 1
            change[end] -= 1
        return [n > 0 for n in accumulate(change[:-1])]

    def recurring(self, template: set[int]) -> list[bool]:
        """Which blocks lie in a template subtree."""
        return self.covered([(a, b) for a, b, h in self.subtrees if h in template])

    def data(self, piece: str) -> None:
        if not piece:
            return
        node = self.stack[-1]
        if not node.unseen:
            node.digest.update(b"\0" + " ".join(piece.split()).encode("utf-8", "replace"))
            self.text.append(html.unescape(piece))

    def flush(self) -> None:
        """End a block; text before an inline element that goes and is still open is a block of its own."""
        done = 0
        for node in self.marked:
            if node.mark is not None:
                self.block(self.text[done : node.mark])
                done, node.mark, node.first = node.mark, None, len(self.blocks)
        self.block(self.text[done:])
        self.text = []

    def block(self, pieces: list[str]) -> None:
        if text := " ".join("".join(pieces).split()):
            self.blocks.append(text)

    def open(self, tag: str, source: str) -> None:
        if tag in CLOSES_PARAGRAPH:
            self.close("p", CLOSES_PARAGRAPH - {"p"})
        for other in SIBLINGS.get(tag, ()):
            self.close(other, LIST_PARTS | {"tr"} if tag in ("td", "th") else LIST_PARTS)
        parent = self.stack[-1]
        unseen = parent.unseen or tag in UNSEEN
        if not unseen:
            parent.digest.update(f"\1{tag}".encode())
        if (tag == "br" or tag == "hr") and not parent.unseen:
            self.text.append(" ")
        if tag in VOID or source.endswith("/") and tag in ("svg", "path", "iframe"):
            return
        if tag not in INLINE:
            self.flush()
        found = attributes_of(source) if source.strip("/ ") and not unseen else {}
        ruled = parent.ruled or is_boilerplate(tag, found, parent.main)
        if tag in ("article", "main", "h1") and not ruled and not unseen and self.classed:
            for node in reversed(self.stack):
                if node.holds:
                    break
                node.holds = True
        classed = bool(found) and not ruled and is_classed(tag, found)
        inline = tag in INLINE and (classed or ruled and not parent.ruled)
        node = Node(tag, len(self.blocks), unseen, ruled, parent.main or tag in ("article", "main"), classed, len(self.text) if inline else None)
        self.stack.append(node)
        self.opened[tag] += 1
        self.foreign += tag in FOREIGN
        self.classed += classed
        if inline:
            self.marked.append(node)

    def close(self, tag: str, barrier: frozenset | set = frozenset()) -> None:
        """Close the nearest open element of this name, and what is open in it; nothing if there is none before a barrier."""
        if not self.opened[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in barrier:
                return

    def pop(self) -> None:
        node = self.stack[-1]
        inline = node.tag in INLINE
        if not inline:
            self.flush()
        self.stack.pop()
        parent = self.stack[-1]
        self.opened[node.tag] -= 1
        self.foreign -= node.tag in FOREIGN
        self.classed -= node.classed
        if node.classed or node.ruled and not parent.ruled:
            if inline:
                self.marked.remove(node)
            if node.ruled or not node.holds:
                if inline:
                    del self.text[node.mark or 0 :]
                self.ranges.append((node.first, len(self.blocks)))
        digest = node.digest.digest()
        if not node.unseen:
            parent.digest.update(digest)
        if inline or node.unseen or node.tag in ("html", "body") or node.first == len(self.blocks):
            return
        running = node.tag == "li" or node.main and (node.tag in ("article", "main", "p", "blockquote", "pre", "table") or node.tag in HEADINGS)
        self.subtrees.append((node.first, len(self.blocks), int.from_bytes(digest, "little", signed=True) & ~1 | running))


class Templates:
    """Template subtrees by host, in two sorted arrays."""

    def __init__(self, rows: pa.Table):
        host, h = (rows.column(c).to_numpy() for c in ("host", "hash"))
        order = np.lexsort((h, host))
        self.host, self.hash = host[order], h[order]

    def among(self, host: int, page: Page) -> set[int]:
        """The page's subtrees that are template on its host."""
        own = self.hash[np.searchsorted(self.host, host, "left") : np.searchsorted(self.host, host, "right")]
        if not len(own) or not page.subtrees:
            return set()
        found = np.unique(np.fromiter((h for _, _, h in page.subtrees), np.int64, len(page.subtrees)))
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        return set(found[own[at] == found].tolist())


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without port or user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES, running_share: float = RUNNING_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points), n_blocks, n_template, n_ruled.

    Element subtrees of every page, menus and footers as well as articles, are hashed and counted by host. A subtree
    is template if it is on at least `least_pages` pages of a host that differ in their main text, and on at least
    `least_share` of them or on `many_pages`. List items everywhere, and running text (paragraphs, headings,
    quotations, preformatted text, tables, the article itself) within article or main, are template on at least
    `running_share` of the host's pages. The whole page and inline elements are none. Blocks in a template go
    (n_template of n_blocks). A small host's pages, and what differs from page to page, leave menus, headers, footers,
    sidebars, notices, adverts, forms and comments that no count tells; of what counting left, those go by their
    element, role, class or id (n_ruled; see Page). Scripts, styles and other unseen elements have no blocks. All
    other text stays. Character references are decoded, white space in a block becomes one space, and the trimmed
    blocks are joined by one space in page order.

    Pages are parsed twice, first for hashes alone. Up to SHARED_TEMPLATES templates go to every task of the second pass
    as two arrays, and no page is dealt; of more, each page's own are found by a join and dealt to it. Equal pages of a host are one page of it. Subtrees are counted by (host, hash) with partial aggregation, and hot keys
    are dealt in parts, so a host with a third of all pages is no burden to one task. Null and empty html give an
    empty text; a null url is a host of its own kind, shared by all such pages. Repeated rows, and rows without an id,
    are extracted each. Other columns are not read. An empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    url, source = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.xxhash64(host_of(url)).alias("host"), F.xxhash64(source).alias("key"), source.alias("html"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("size").to_pylist(), SLICE_BYTES):
                own = batch.slice(a, b - a)
                found, texts = [], []
                for x in own.column("html"):
                    page = Page(x.as_py())
                    found.append(sorted({h for _, _, h in page.subtrees}))
                    main = "\n".join(t for t, gone in zip(page.blocks, page.ruled) if not gone)
                    texts.append(int.from_bytes(hashlib.blake2b(main.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_arrays([own.column("host"), own.column("key"), pa.array(texts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "key", "page", "hashes"])

    sized = rows.select("host", "key", "html", F.octet_length("html").alias("size"))
    parsed = sized.mapInArrow(hashed, "host long, key long, page long, hashes array<long>")
    each = stored(parsed.groupBy("host", "key").agg(F.count("*").alias("n"), F.any_value("page").alias("page"), F.any_value("hashes").alias("hashes")))

    held = each.select("host", "key", "page", F.explode("hashes").alias("hash"))
    totals = each.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    subtree = F.shiftright("hash", 1)
    on = held.groupBy("host", subtree.alias("subtree"), "page").agg(F.count("*").alias("n")).groupBy("host", "subtree").agg(F.count("*").alias("seen"), F.sum("n").alias("n"))
    often = F.col("seen") >= running_share * F.col("pages")
    enough = (F.col("seen") >= least_share * F.col("pages")) | (F.col("seen") >= many_pages)
    counted = on.where(F.col("seen") >= least_pages).join(totals, "host").where(often | enough)
    # Each kind by its own share; a subtree is counted over both.
    kinds = F.filter(F.array(F.when(enough, F.lit(0)), F.when(often, F.lit(1))), lambda k: k.isNotNull())
    template = stored(counted.select("host", "subtree", "n", F.explode(kinds).alias("kind")).select("host", (F.shiftleft("subtree", 1) + F.col("kind")).alias("hash"), "n"))
    if template.count() <= SHARED_TEMPLATES:
        shared = pages.sparkSession.sparkContext.broadcast(Templates(template.select("host", "hash").toArrow()))
        dealt = rows.withColumn("drop", F.lit(None).cast("array<long>"))
    else:
        shared = None
        gone = spread_join(held.select("host", "key", "hash"), template.drop("n"), ["host", "hash"], hot_keys(template, ["host", "hash"], "n"), F.col("key"))
        drops = stored(gone.groupBy("host", "key").agg(F.collect_set("hash").alias("drop")))
        dealt = spread_join(rows, drops, ["host", "key"], hot_keys(each, ["host", "key"], "n"), F.col("page_id"), "left")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("size").to_pylist(), SLICE_BYTES):
                own = batch.slice(a, b - a)
                texts, counts = [], []
                for x, host, drop in zip(own.column("html"), own.column("host").to_pylist(), own.column("drop").to_pylist()):
                    page = Page(x.as_py())
                    found = shared.value.among(host, page) if shared else set(drop or ())
                    template = page.recurring(found) if found else [False] * len(page.blocks)
                    texts.append(" ".join(t for t, p, q in zip(page.blocks, template, page.ruled) if not p and not q))
                    counts.append((len(page.blocks), sum(template), sum(q and not p for p, q in zip(template, page.ruled))))
                numbers = [pa.array(c, pa.int64()) for c in zip(*counts)]
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(texts, pa.string()), *numbers], ["page_id", "url", "text", "n_blocks", "n_template", "n_ruled"])

    final = dealt.select("page_id", "url", "html", "host", "drop", F.octet_length("html").alias("size")).mapInArrow(extracted, f"page_id {kind}, url string, text string, n_blocks long, n_template long, n_ruled long")
    return final.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_template", "n_ruled")
