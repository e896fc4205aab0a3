"""Main text of web pages by site style trees.

Pages of one host are merged into a style tree: an element is known by its path of
tags and classes. Over the host's pages a path's presentation importance is the
normalised entropy of its children's layouts, and its content importance is one
minus the mean normalised entropy of its texts over pages, so text that many pages
repeat weighs little. A branch's composite importance is that of its texts, by length, and a
little of its layout's. A page's branch is removed if its importance is low against that of the
page's text as a whole: then a host of copies loses nothing. What a host has too few pages to tell is removed
if tag, role, class or id names it as a menu, header, footer, sidebar, notice, advert,
form or reader comment; scripts and styles always are. What is left of the article gives the text.

Paths on two pages or more are in the tree, whatever the number of the host's pages. Inside an article prose
(paragraphs, headings, lists, tables) is never removed for its importance: an article's repeated words are its own.

A null html is an empty page. Broken markup is read leniently: unclosed tags end with
their parent, stray end tags are ignored. A page without text has an empty text. Pages
without a host, or alone on their host, are judged by names alone. Repeated rows stay. An empty table gives an
empty result. Very long pages are parsed whole, one at a time. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, tidied
from .url_filter import host_of

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>?", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements by kind, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption legend".split()
)
ENDS_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "tfoot", "thead", "tr", "li", "dd", "dt"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
HOLDS = frozenset("ul ol dl table article section div body select menu nav aside main td".split())
#: Names of what isn't the article.
NO_TEXT = frozenset("script style noscript template iframe object embed canvas svg textarea head title audio video noframes noembed xmp map".split())
DROP_TAGS = frozenset("nav footer aside form button select option input dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidenav menu navbar nav navigation breadcrumb breadcrumbs footer footnav masthead topbar comment comments respond disqus replies reply share sharing social related recommended recommendations "
    "widget pagination pager toolbar login signup search skip".split()
)
HEADERS = frozenset(("header", "masthead"))
KEEP = frozenset(("html", "body", "article", "main"))
#: Elements that hold an article's own words: inside an article only wrappers of other kinds can be found unimportant.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre b i em strong a span code sub sup figure figcaption header hgroup".split())


def _path(parent: int, sig: str) -> int:
    return xxhash.xxh64_intdigest(sig, parent & 0xFFFFFFFFFFFFFFFF) >> 1


class Page:
    """The elements of a page, in order: tag, parent, path, whether it has no text, whether names remove it; and its text pieces."""

    __slots__ = ("tag", "parent", "path", "void", "named", "items")

    def __init__(self, html: str):
        self.tag, self.parent, self.path, self.void, self.named = ["#"], [0], [0], [False], [False]
        self.items: list[tuple[int, str]] = []  # (element, text), with "" where a block begins or ends
        self._read(html)

    def _open(self, tag: str, attrs: str, up: int) -> int:
        sig, drop = tag, tag in DROP_TAGS
        names: set[str] = set()
        if attrs and attrs != "/":
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "class" or name == "id":
                    if name == "class" and value:
                        sig += "." + value
                    names.update(re.split(r"[^a-z0-9]+", re.sub(r"[^\x00-\x7f]", "", value)))
                elif name == "role":
                    drop = drop or value in DROP_ROLES
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    drop = True
                elif name == "style":
                    drop = drop or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        if names and not names.isdisjoint(DROP_NAMES):
            drop = True
        if tag in HEADERS or not names.isdisjoint(HEADERS):  # an article's own header is text
            at = up
            while at and self.tag[at] not in ("article", "main"):
                at = self.parent[at]
            drop = drop or not at
        if tag in KEEP:
            # an article among reader comments goes with its parent
            drop = tag == "article" and not names.isdisjoint({"comment", "comments", "reply"})
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(_path(self.path[up], sig))
        self.void.append(tag in NO_TEXT or self.void[up])
        self.named.append(drop or self.named[up])
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        at, here, n = 0, 0, len(html)
        tags, parent, items = self.tag, self.parent, self.items
        scan = _TAG.search
        opened: dict[str, int] = {}  # elements above by tag, so that a stray end tag costs nothing

        def close_to(node: int, target: int) -> int:
            while node != target:
                opened[tags[node]] -= 1
                node = parent[node]
            return target

        while at < n:
            m = scan(html, at)
            if m is None:
                self._text(here, html[at:])
                break
            if m.start() > at:
                self._text(here, html[at : m.start()])
            at = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if tag == "p" or tag in BLOCK:
                    items.append((here, ""))
                if opened.get(tag):
                    up = here
                    while tags[up] != tag:
                        up = parent[up]
                    here = close_to(here, parent[up])
                continue
            if tag in BLOCK:
                items.append((here, ""))
                if tag in ENDS_P:
                    up = here
                    while up and tags[up] not in BLOCK and tags[up] not in ("td", "th"):
                        up = parent[up]
                    if up and tags[up] == "p":
                        here = close_to(here, parent[up])
            ends = CLOSES.get(tag)
            if ends:
                up = here
                while up and tags[up] not in ends and tags[up] not in HOLDS:
                    up = parent[up]
                while up and tags[up] in ends and not (tags[up] in HOLDS and tag not in ("td", "th", "tr")):
                    here = up = close_to(here, parent[up])
            node = self._open(tag, attrs, here)
            if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
                if tag == "br" or tag == "hr":
                    items.append((here, " "))
                continue
            if tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at)
                at = m.end() if m else n
                continue
            if tag in ("td", "th"):
                items.append((here, " "))
            opened[tag] = opened.get(tag, 0) + 1
            here = node

    def _text(self, node: int, raw: str) -> None:
        self.items.append((node, html_lib.unescape(raw) if "&" in raw else raw))

    def features(self) -> set[tuple[int, int, int]]:
        """(path, kind, feature) of the elements that may have text: 0 presence, 1 layout of children, 2 a text."""
        out, kids, own = set(), {}, {}
        for i in range(1, len(self.tag)):
            if not self.void[i]:
                kids.setdefault(self.parent[i], []).append(self.tag[i])
                out.add((self.path[i], 0, 0))
        for i, layout in kids.items():
            if i:
                out.add((self.path[i], 1, _path(1, " ".join(layout))))
        for i, t in self.items:
            if i and t and not self.void[i] and not t.isspace():
                own.setdefault(i, []).append(t)
        for i, parts in own.items():
            out.add((self.path[i], 2, _path(2, " ".join(" ".join(parts).split()))))
        return out

    def unimportant(self, tree: dict[int, tuple[float, float]], least: float, gamma: float) -> list[bool]:
        """Whether each element is in a branch whose composite importance is under ``least`` of that of the page's text."""
        n = len(self.tag)
        out = [False] * n
        if not any(p in tree for p in self.path):
            return out
        mass, worth, total, best = [0.0] * n, [0.0] * n, 0.0, 0.0
        for i, t in self.items:
            if t and not self.void[i] and not t.isspace():
                size, w = len(t), tree.get(self.path[i], (1.0, 1.0))[0]
                mass[i] += size
                worth[i] += size * w
                total += size * w
                best += size * w * w
        bar = least * gamma * best / total if total else 0.0  # the mean importance of the text, weighed by importance
        for i in range(n - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
            worth[self.parent[i]] += worth[i]
        inner = [False] * n
        for i in range(1, n):
            inner[i] = inner[self.parent[i]] or self.tag[i] in ("article", "main")
            if out[self.parent[i]]:
                out[i] = True
            elif mass[i] and self.tag[i] not in KEEP and not (inner[i] and self.tag[i] in PROSE):
                layout = tree.get(self.path[i], (1.0, 0.0))[1]
                out[i] = gamma * worth[i] / mass[i] + (1 - gamma) * layout < bar
        return out

    def text(self, tree: dict[int, tuple[float, float]], least: float, gamma: float, names: bool = True) -> str:
        """The article's blocks joined by newlines; without ``names`` the tree alone decides."""
        n = len(self.tag)
        drop = [a or b for a, b in zip(self.void, self.unimportant(tree, least, gamma), strict=True)]
        if names:
            drop = [a or b for a, b in zip(drop, self.named, strict=True)]
        main = [False] * n
        kind = "article" if any(t == "article" and not drop[i] for i, t in enumerate(self.tag)) else "main" if any(t == "main" and not drop[i] for i, t in enumerate(self.tag)) else None
        for i in range(1, n):
            main[i] = kind is None or main[self.parent[i]] or self.tag[i] == kind
        main[0] = kind is None
        blocks, held = [], []
        for i, t in self.items:
            if t:
                if main[i] and not drop[i]:
                    held.append(t)
            elif held:
                s = " ".join("".join(held).split())
                if s:
                    blocks.append(s)
                held = []
        s = " ".join("".join(held).split())
        return "\n".join([*blocks, s] if s else blocks)


def style_trees(pages: DataFrame, scratch: Scratch, most_important: float = 0.95) -> DataFrame:
    """(host, tree): the paths on two pages or more of each host whose content is not almost all its pages' own.

    Counted by (host, path, feature), so a host with a third of all pages is no single task's work.
    A path that is left out counts as important.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple, int] = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in Page(html or "").features():
                    k = (host, *f)
                    counts[k] = counts.get(k, 0) + 1
            cols = list(zip(*counts, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["host", "path", "kind", "feature", "k"])

    found = pages.filter("host <> ''").select("host", "html").mapInArrow(tidied(emit), "host string, path bigint, kind int, feature bigint, k bigint")
    k = found.groupBy("host", "path", "kind", "feature").agg(F.sum("k").cast("double").alias("k"))
    log_k = F.col("k") * F.log("k")
    node = k.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("k"))).alias("m"),
        F.sum(F.when(F.col("kind") == 1, log_k)).alias("s1"), F.sum(F.when(F.col("kind") == 1, F.col("k"))).alias("n1"),
        F.sum(F.when(F.col("kind") == 2, log_k)).alias("s2"), F.sum(F.when(F.col("kind") == 2, F.col("k"))).alias("n2"),
    ).filter("m > 1")
    content = F.when(F.col("n2") > 0, 1 - F.col("s2") / (F.col("n2") * F.log("m"))).otherwise(1.0)
    layout = F.when(F.col("n1") > 0, (F.log("n1") - F.col("s1") / F.col("n1")) / F.log(F.greatest("m", "n1"))).otherwise(0.0)
    kept = node.select("host", "path", content.alias("content"), layout.alias("layout")).filter(F.col("content") < most_important)
    return scratch.save(kept.groupBy("host").agg(F.collect_list(F.struct("path", "content", "layout")).alias("tree")), "trees")


def extract(pages: DataFrame, least: float = 0.85, gamma: float = 0.9, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    spark = pages.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "html")
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host_of(F.col(url)).alias("host"))
    trees = style_trees(src, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for b in batches:
            texts = []
            for host, page, tree in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4), strict=True):
                if host not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[host] = {t["path"]: (t["content"], t["layout"]) for t in tree.as_py() or ()}
                texts.append(Page(page or "").text(known[host], least, gamma))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = src.schema["page_id"].dataType.simpleString()
    return src.join(trees, "host", "left").select("page_id", "url", "html", "host", "tree").mapInArrow(tidied(run), f"page_id {kind}, url string, text string, n_chars bigint")
