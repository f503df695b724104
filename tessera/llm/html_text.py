"""Operator 10: main text of web pages by tag-path ratios.

A page becomes a row of text blocks, each with its path of tags from the root to the leaf. Paths
are nodes of a trie (parent, tag, class and id), so time and memory are linear in the page. Per
path, text length and punctuation are summed and divided by the number of blocks; both ratios are
smoothed over the row of blocks (a Gaussian), fused by their product, scaled by a bounded factor for
what tags and class names on the path say of boilerplate and content, and averaged by path again. Content are the
blocks whose fused ratio passes the threshold (a share of its deviation and mean over the page), whatever
their names. Two kinds of short blocks go with them: headings before such a block of the same named
element or article, and blocks between two such blocks of it; not those with a class or id of their
own, within boilerplate by name, or made of links mostly.

A null html is empty; it, and a page without content, has an empty text. Unclosed, misnested and
cut-off markup is read as browsers read it, near enough; an end tag, or a start tag that ends others,
reaches up REACH open elements at most where others stand between. Null and repeated page_ids are kept.
Pages of any length are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices, table

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Tags whose content isn't text, tags without content, and tags that don't part blocks.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "object", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What a start tag closes, up to the nearest of the tags beside it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Boilerplate by tag and by words, or beginnings of words, in class, id and role.
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
_OUT_WORDS = {"ad", "ads", "nav", "menu", "aside", "share", "social", "tags", "meta", "legal", "widget", "consent", "login", "search", "related", "toolbar", "contentinfo", "complementary", "notice", "notices", "alert", "promo", "replies", "reply", "respond"}
_OUT_STARTS = ("advert", "sidebar", "footer", "header", "comment", "cookie", "banner", "sponsor", "newsletter", "subscri", "breadcrumb", "pagination", "navbar", "navigation", "popup", "modal", "disclaimer", "disqus", "promo", "masthead", "gdpr")
_IN_TAGS = {"article", "main"}
#: Elements that hold blocks together even without a class or id.
_HOMES = {"article", "main", "body", "html"}
_IN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
_MARKS = re.compile(r"[.,;:!?…。，、！？]")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What boilerplate, unknown and content names multiply a ratio by; and open elements that a tag looks past.
FACTORS, REACH = (0.05, 1.0, 2.0), 64
#: Shares of the deviation and of the mean (pages of equal blocks have no deviation) that a path's
#: fused ratio has to reach, and the smoothing kernel.
THRESHOLD, LEAST, _SMOOTH = 0.6, 0.2, np.exp(-0.5 * np.arange(-2, 3) ** 2)


def _kind(tag: str, attributes: str) -> int:
    """0: boilerplate; 1: nothing known; 2: named as content."""
    if tag in _OUTSIDE:
        return 0
    words = {w for x in _NAMES.findall(attributes) for w in re.split(r"[^a-z0-9]+", x.lower())} if attributes else set()
    if tag not in ("body", "html", "article", "main") and (words & _OUT_WORDS or any(w.startswith(_OUT_STARTS) for w in words)):
        return 0
    return 2 if tag in _IN_TAGS or words & _IN_WORDS else 1


class _Element(NamedTuple):
    """An open element: number, node of its path, whether it or one around it is named as boilerplate,
    the highest kind so far, whether it has a class or id, and the nearest named element or article
    around it."""

    tag: str
    number: int
    path: int
    outside: bool
    kind: int
    named: bool
    home: int


_ROOT = _Element("", 0, 0, False, 1, False, 0)


class _Block(NamedTuple):
    """A run of text: its element and node of path, kind, text, and whether it may go with others."""

    element: _Element
    kind: int
    text: str
    goes_along: bool


class _Page:
    """The blocks of a page in order."""

    def __init__(self, page: str):
        self.blocks: list[_Block] = []
        self.stack: list[_Element] = [_ROOT]
        self.open_tags: Counter[str] = Counter()
        self.paths: dict[tuple[int, str], int] = {}
        self.text: list[str] = []
        self.link, self.linked = False, 0  # inside of a link; characters of links in the text so far
        self.number = 0
        at = 0
        while True:
            found = _MARKUP.search(page, at)
            piece = page[at : found.start() if found else len(page)]
            if piece:
                self.text.append(entities.unescape(piece) if "&" in piece else piece)
                if self.link:
                    self.linked += len(self.text[-1].strip())
            if not found:
                break
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self.close(tag)
            elif tag in _RAW:
                closed = found[3].rstrip().endswith("/")
                end = None if closed else re.compile(rf"</{re.escape(tag)}(?![a-z0-9-])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else at if closed else len(page)
            elif tag == "br":
                self.text.append(" ")
            elif tag in _VOID:
                if tag == "hr":
                    self.flush()
            elif tag not in _INLINE:
                self.open(tag, found[3])
            elif tag == "a":
                self.link = True
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split()) if self.text else ""
        self.text.clear()
        if text:
            top = self.stack[-1]
            self.blocks.append(_Block(top, 0 if top.outside else top.kind, text, not top.named and not top.outside and 2 * self.linked <= len(text)))
        self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        self.pop({"p"}, set())
        if tag in _CLOSES:
            self.pop(*_CLOSES[tag])
        self.number += 1
        names = "".join(sorted({"." + w for x in _NAMES.findall(attributes) for w in x.lower().strip("\"'").split()})) if attributes.strip() else ""
        top, kind = self.stack[-1], _kind(tag, attributes)
        home = top.number if top.tag in _HOMES or top.named and top.tag != "section" else top.home
        path = self.paths.setdefault((top.path, tag + names), len(self.paths) + 1)
        self.stack.append(_Element(tag, self.number, path, top.outside or kind == 0, max(top.kind, kind), bool(names), home))
        self.open_tags[tag] += 1

    def cut(self, k: int) -> None:
        for x in self.stack[k:]:
            self.open_tags[x.tag] -= 1
        del self.stack[k:]

    def pop(self, tags: set[str], stop: set[str]) -> None:
        if any(self.open_tags[t] for t in tags):
            for k in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - REACH), -1):
                if self.stack[k].tag in stop:
                    return
                if self.stack[k].tag in tags:
                    return self.cut(k)

    def close(self, tag: str) -> None:
        if tag in _INLINE:
            if tag == "a":
                self.link = False
            return
        self.flush()
        self.pop({tag}, set())


def fused_ratios(blocks: list[_Block]) -> np.ndarray:
    """The fused and smoothed ratio of text length and punctuation of each block's path."""
    path = np.unique([b.element.path for b in blocks], return_inverse=True)[1]
    size = np.bincount(path)
    length, marks = ((np.bincount(path, x) / size)[path] for x in ([len(b.text) for b in blocks], [len(_MARKS.findall(b.text)) for b in blocks]))
    if len(blocks) >= 5:
        weight = np.convolve(np.ones(len(blocks)), _SMOOTH, "same")
        length, marks = (np.convolve(x, _SMOOTH, "same") / weight for x in (length, marks))
    fused = length * (1 + marks) * np.array(FACTORS)[[b.kind for b in blocks]]
    return (np.bincount(path, fused) / size)[path]


def main_text(page: str | None) -> str:
    """The page's main text: its content blocks, one a line."""
    blocks = _Page(page or "").blocks
    if not blocks or all(b.kind == 0 for b in blocks):
        return ""
    ratio = fused_ratios(blocks)
    strong = (ratio > 0) & (ratio >= max(THRESHOLD * float(np.std(ratio)), LEAST * float(np.mean(ratio))))
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for k in np.flatnonzero(strong).tolist():
        for home in (blocks[k].element.home, blocks[k].element.number):
            first.setdefault(home, k)
            last[home] = k

    def stays(k: int, b: _Block) -> bool:
        home = b.element.home
        return b.goes_along and k < last.get(home, -1) and (k > first[home] or b.element.tag in _HEADINGS)

    return "\n".join(b.text for k, b in enumerate(blocks) if strong[k] or stays(k, b))


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with their main text in place of the html."""
    kept = [f for f in pages.schema.fields if f.name not in (html, into)]
    schema = T.StructType([*kept, T.StructField(into, T.StringType())])

    def run(batches):
        for batch in batches:
            for rows in slices(batch, html):
                texts = pa.array([main_text(x) for x in rows.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), texts], names=schema.names)

    return pages.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
