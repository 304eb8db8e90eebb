"""Main text of web pages by tag-path ratios.

Each text node belongs to a root-to-leaf tag path. Per path, text length and punctuation per node are aggregated; both
ratios are smoothed over neighbouring nodes, weighted by how much of their paths they share, and fused; nodes whose path is
over a share of the page's deviation are content. The article is the least element around the headline and the paths that hold
the bulk of the content, by the sums of their nodes. In it stay the blocks of paths that pass, headings, and short blocks in a
box with content; a box of its own kind whose paths don't pass by themselves goes, and so do branches built like a list of
comments. Paths alone tell adverts and menus from the article, whatever they are called. HTML's own words for page furniture
(nav, footer, aside, role) count too, and names of prose that reads like an article's (comments, notices). An `article`
element decides where a page has less than LITTLE content, too little for ratios to compare.
Paths, elements and blocks are numbered, so time grows with the page, not with its depth.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .shared import ship_code

# Fixed values of HTML: elements without content, with raw text, that stand in a line, that close an open element of a kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|select"
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body article section div main td th li ul ol table blockquote form nav aside footer header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table thead tbody tfoot tr".split())
FLOW = INLINE | HEADINGS | LISTS | frozenset("p li dt dd td th caption blockquote pre address figcaption center".split())  # no boxes of their own
PARTS = frozenset("article main section figure details html body".split())  # boxes that are no furniture by themselves
FURNITURE_TAGS = frozenset("head nav footer aside form header button menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words of class names and ids: prose beside the article, which ratios can't tell from it, and words that may stand beside those.
FURNITURE_WORDS = frozenset("comment comments consent cookie cookies disclaimer newsletter notice related replies reply respond".split())
LAYOUT_WORDS = frozenset("area article bar block box container content inner item items left link links list main outer page post reader right section site slot thread top user wrap wrapper".split())

LITTLE = 1000  # characters

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(" + RAW + r")\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？…]")
_SENTENCE = re.compile(r"[.!?。！？…][\"')\]]*$")
_SPACE = re.compile(r"\s+")


def _step(tag: str, attributes: str, top: bool) -> tuple[str, bool, bool]:
    """(path step, furniture by HTML's words, furniture by its names). Only a header or footer outside articles is the page's."""
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    bad = tag in FURNITURE_TAGS and (tag not in ("header", "footer") or top) or found.get("role") in FURNITURE_ROLES or "hidden" in found
    named = False
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        words = set(_WORD.findall(name))
        named = named or bool(words & FURNITURE_WORDS) and words <= FURNITURE_WORDS | LAYOUT_WORDS
    return tag + ("." + _DIGITS.sub("#", found["class"]) if found.get("class") else ""), bad, named


class Page:
    """A page's elements, tag paths and text nodes, numbered in page order; element 0 and path 0 stand for the page itself.

    Elements left open are closed as browsers do for the common cases. An element's box is the nearest one around it that
    isn't a line, paragraph, heading, list or table.
    """

    def __init__(self, page: str, by_name: bool = True):
        self.tag, self.parent, self.end, self.path, self.bad, self.box, self.head, self.by_name = ["html"], [0], [0], [0], [False], [0], [False], by_name
        self.path_parent, self.path_depth, self.path_jump = [0], [0], [0]
        self.text: list[str] = []
        self.element: list[int] = []  # of each text node
        self.block: list[int] = []
        self._read(page)

    def _path(self, known: dict, parent: int, step: str) -> int:
        found = known.get((parent, step))
        if found is None:
            found = known[parent, step] = len(self.path_parent)
            up = self.path_jump[parent]
            far = self.path_depth[parent] - self.path_depth[up] == self.path_depth[up] - self.path_depth[self.path_jump[up]]
            self.path_parent.append(parent)
            self.path_depth.append(self.path_depth[parent] + 1)
            self.path_jump.append(self.path_jump[up] if far else parent)
        return found

    def _read(self, page: str) -> None:
        known: dict[tuple[int, str], int] = {}
        open_ = [0]
        at: dict[str, list[int]] = defaultdict(list)  # places in open_ of each tag
        scopes, blocks, parts = [0], [0], []  # of those that bound a search, that aren't lines, that are articles
        block = 0

        def cut(to: int) -> None:
            nonlocal block
            if blocks[-1] >= to:
                block += 1
            for e in open_[to:]:
                at[self.tag[e]].pop()
                self.end[e] = len(self.tag) - 1
            del open_[to:]
            for places in (scopes, blocks, parts):
                while places and places[-1] >= to:
                    places.pop()

        for m in _TOKEN.finditer(page):
            tag = m[3]
            if tag is None:
                if m[1] is None and page[m.start()] != "<" or m[0] == "<":
                    self._add(m[0], open_[-1], block)
                continue
            tag = tag.lower()
            if m[2]:
                if at[tag] and not (tag in INLINE and scopes[-1] > at[tag][-1]):
                    cut(at[tag][-1])
                elif tag not in INLINE:
                    block += 1
                continue
            if tag in ENDS_P or tag in CLOSED_BY:
                last = max((at[t][-1] for t in CLOSED_BY.get(tag, ("p",)) if at[t]), default=-1)
                if last >= 0 and (last >= scopes[-1]):
                    cut(last)
            if tag not in INLINE:
                block += 1
            elif tag == "br" or tag == "img":
                self._add(" ", open_[-1], block)
            if tag not in VOID and not m[4].endswith("/"):
                up = open_[-1]
                step, bad, named = _step(tag, m[4], not parts)
                e, place = len(self.tag), len(open_)
                self.tag.append(tag)
                self.parent.append(up)
                self.end.append(e)
                self.path.append(self._path(known, self.path[up], step))
                self.bad.append(bad or named and self.by_name or self.bad[up])
                self.box.append(self.box[up] if tag in FLOW else e)
                self.head.append(tag in HEADINGS or self.head[up])
                open_.append(e)
                at[tag].append(place)
                if tag in SCOPE:
                    scopes.append(place)
                if tag not in INLINE:
                    blocks.append(place)
                if tag == "article" or tag == "main":
                    parts.append(place)
        cut(1)
        self.end[0] = len(self.tag) - 1

    def _add(self, text: str, element: int, block: int) -> None:
        self.text.append(text)
        self.element.append(element)
        self.block.append(block)

    def shared(self, a: int, b: int) -> float:
        """How much of two paths is the same beginning; their common path is found by jumps, in logarithmic time."""
        depth, jump, parent = self.path_depth, self.path_jump, self.path_parent
        most = max(depth[a], depth[b], 1)
        if depth[a] < depth[b]:
            a, b = b, a
        while depth[a] > depth[b]:
            a = jump[a] if depth[jump[a]] >= depth[b] else parent[a]
        while a != b:
            a, b = (jump[a], jump[b]) if jump[a] != jump[b] else (parent[a], parent[b])
        return depth[a] / most


def content_paths(page: Page, radius: int = 2, share: float = 0.5, sums: bool = False) -> dict[int, float]:
    """Weight of each tag path that passes the threshold; of a path's text and punctuation per node, or as sums of all its nodes."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    paths = []
    for text, e in zip(page.text, page.element):
        if not page.bad[e] and text.strip():
            p = page.path[e]
            paths.append(p)
            length[p] += len(text)
            marks[p] += len(_PUNCTUATION.findall(text))
            count[p] += 1
    ratio = {p: (length[p], 1 + marks[p]) if sums else (length[p] / count[p], (1 + marks[p]) / count[p]) for p in count}
    near: dict[tuple[int, int], float] = {}
    best: dict[int, float] = {}
    for i, p in enumerate(paths):
        total = length_ = marks_ = 0.0
        for j in range(max(0, i - radius), min(len(paths), i + radius + 1)):
            q = paths[j]
            if (p, q) not in near:
                near[p, q] = 1.0 if p == q else page.shared(p, q)
            w = near[p, q] / (1 + abs(i - j))
            total, length_, marks_ = total + w, length_ + w * ratio[q][0], marks_ + w * ratio[q][1]
        best[p] = max(best.get(p, 0.0), length_ * marks_ / (total or 1.0) ** 2)
    if not best:
        return {}
    values = list(best.values())
    bar = min(share * pstdev(values), max(values))
    return {p: v for p, v in best.items() if v >= bar}


class Article:
    """Which elements of a page hold content, and which of them is the article."""

    def __init__(self, page: Page, paths: dict[int, float]):
        n = len(page.tag)
        self.page, self.mass, self.own = page, [0] * n, [0] * n  # characters of content in an element, and with it as their box
        self.firm, self.core = [0] * n, [0] * n  # those of own, and mass, on paths that pass without neighbours, by nodes and by sums
        alone, bulk = content_paths(page, radius=0, share=1.0), content_paths(page, radius=0, share=1.0, sums=True)
        self.label: list[int | None] = [None] * n  # 1 if an element's first block is a short one without a sentence and no heading, else 0
        self.blocks = [0] * n
        seen = -1
        for text, e, block in zip(page.text, page.element, page.block):
            text = text.strip()
            if not text or page.bad[e]:
                continue
            if page.path[e] in paths:
                self.mass[e] += len(text)
                self.own[page.box[e]] += len(text)
                self.firm[page.box[e]] += len(text) if page.path[e] in alone else 0
                self.core[e] += len(text) if page.path[e] in bulk else 0
            if block != seen:
                self.blocks[e] += 1
                seen = block
            if self.label[e] is None:
                self.label[e] = int(len(text) <= 60 and not _SENTENCE.search(text) and not page.head[e])
        first: list[int] = list(range(n))
        for e in range(n - 1, 0, -1):  # children come after their parents
            up = page.parent[e]
            self.mass[up] += self.mass[e]
            self.core[up] += self.core[e]
            self.blocks[up] += self.blocks[e]
            if self.label[e] is not None and (self.label[up] is None or first[e] > up):
                self.label[up], first[up] = self.label[e], first[e]
        self.children: dict[int, list[int]] = defaultdict(list)
        for e in range(1, n):
            if self.mass[e]:
                self.children[page.parent[e]].append(e)

    def root(self) -> int:
        """The least element around the headline and all but a thirtieth of what the heaviest paths hold.

        With little content it is the innermost article with a headline, or without one.
        """
        page, at = self.page, 0
        heads = [e for e in range(1, len(page.tag)) if page.tag[e] == "h1" and not page.bad[e]]
        if self.mass[0] < LITTLE:
            marked = [e for e in range(1, len(page.tag)) if page.tag[e] in ("article", "main") and self.blocks[e] and not page.bad[e]]
            headed = [e for e in marked if self._between(heads, e)]
            if marked:
                return (headed or marked)[-1]
        while not self.own[at] and self.children[at]:
            down = max(self.children[at], key=lambda e: self.core[e])
            outside = self._between(heads, at) and not self._between(heads, down)
            if page.tag[down] in FLOW or 30 * self.core[down] < 29 * self.core[at] or at and page.tag[at] != "body" and outside:
                break
            at = down
        return at

    def _between(self, heads: list[int], e: int) -> bool:
        """Whether one of the elements, in page order, lies in e."""
        at = bisect_left(heads, e)
        return at < len(heads) and heads[at] <= self.page.end[e]

    def comments(self, e: int) -> bool:
        """A branch all of whose content lies in parts of one kind that begin with a name or date, not with a heading."""
        page = self.page
        parts = defaultdict(list)
        for c in self.children[e]:
            if self.blocks[c] > 1 and self.label[c]:
                parts[page.path[c]].append(c)
        most = max(parts.values(), key=len, default=[])
        return len(most) > 1 and 10 * sum(self.mass[c] for c in most) >= 9 * self.mass[e]

    def kept(self) -> list[int]:
        """Blocks of the article, in order, as the numbers of their text nodes' blocks.

        A box of its own kind (an advert between paragraphs) stays only if a path in it passes by its own ratios.
        """
        page, root = self.page, self.root()
        gone = [False] * len(page.tag)
        boxes = {page.path[e] for e in range(root, page.end[root] + 1) if self.firm[e]}
        for e in range(root + 1, page.end[root] + 1):
            own = 2 * self.mass[e] < self.mass[root] and page.tag[e] not in FLOW | PARTS and self.comments(e)
            gone[e] = page.bad[e] or gone[page.parent[e]] or own
        out: dict[int, bool] = {}
        for text, e, block in zip(page.text, page.element, page.block):
            if root <= e <= page.end[root] and not gone[e] and not page.bad[e] and text.strip():
                box = page.box[e]
                beside = box <= root or page.tag[box] in PARTS or page.path[box] in boxes
                out[block] = out.get(block, False) or page.head[e] or beside
        return [b for b, keep in out.items() if keep]


def main_text(page: str) -> str:
    """The article's blocks, one a line; "" if none."""
    read = Page(page)
    paths = content_paths(read)
    if not paths:  # nothing but what names call furniture
        read = Page(page, by_name=False)
        paths = content_paths(read)
    if not paths:
        return ""
    blocks: dict[int, list[str]] = {b: [] for b in Article(read, paths).kept()}
    for text, e, block in zip(read.text, read.element, read.block):
        if block in blocks and not read.bad[e]:
            blocks[block].append(text)
    lines = (_SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks.values())
    return "\n".join(line for line in lines if line)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            found = [main_text(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of `pages` (page_id, url, html).

    A null or empty html, or one without text outside page furniture, gives "". Null ids and urls and repeated rows pass
    through. Other columns are ignored; an empty table gives an empty one. No shuffle: each page stands by itself.
    """
    ship_code(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
