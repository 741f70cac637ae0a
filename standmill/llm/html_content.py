"""Main text of web pages by tag-path ratios.

A page is read once into text blocks with their root-to-leaf tag paths. Elements whose kind is never main text (menus,
footers, sidebars, forms, scripts, styles, page headers) are left out by tag and role; a class or id that is made of
words for such things only marks the path's label and lowers its score.

Per tag path, text length (without links) and punctuation are summed and divided by the path's number of blocks; the two
ratios are fused, smoothed with those of the parent path, and weighed down by the share of links and by marks. This is
done twice. First over the page: the paths that reach a threshold, from the mean and the spread of all blocks, are the
core, and the innermost element that holds nearly all text of the core (or the article or main element around it) is the
content element. Then within the content element, where a path inherits most of the score of the paths around it, so
that headings, short paragraphs, lists and tables stay: the paths that reach a share of the mean are the content nodes,
and their blocks are the text.

Pages are independent of each other: the work needs no shuffle. It is linear in the page's length at any depth.

Defined results: a null or empty page, or one without main text, has an empty text; unclosed and misplaced tags are
closed as browsers do it roughly; a line break ends a block; elements are read at any depth; very long pages count
whole; of equally fit content elements the innermost is taken; every row gives a row, with repeated ids too; an empty
table gives an empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standmill.llm.common import map_slices

#: Elements whose content is not text, that are never main text, that break text into blocks, or that are never closed.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "noframes"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "label", "input", "fieldset", "datalist"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar", "alertdialog"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "commentlist", "disqus", "respond", "reply",
    "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search",
    "widget", "widgets", "pagination", "pager", "toolbar", "topbar", "masthead", "copyright", "legal", "disclaimer", "skip", "tags", "teaser", "teasers",
}
#: Words that may stand beside those in a class or id that marks a path.
NEUTRAL = {
    "area", "article", "bar", "block", "bottom", "box", "col", "column", "container", "content", "global", "inner", "item", "items", "left", "link", "links", "list", "main", "module", "outer",
    "page", "panel", "post", "primary", "right", "row", "secondary", "section", "site", "slot", "text", "top", "unit", "wrap", "wrapper",
}
#: Elements that a new element of the kind closes, unless one of the holders stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "main", "body"}

_MARK = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=|[\"'])*+)>|<[!?][^>]*+>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…、。¿¡]")
_SPACE = re.compile(r"\s+")
_LETTERS = re.compile(r"[a-z]+")
#: The content element holds this share of the core's text.
SHARE = 0.9
#: What a path takes of its parent's score: over the page, and within the content element.
PAGE_SMOOTHING, CONTENT_SMOOTHING = 0.3, 0.8
#: A content node's score in means of the content element's blocks, at least; and what a mark leaves of a score.
LEAST, MARKED = 0.1, 0.02


@dataclass
class Block:
    text: str
    element: int
    links: int


@dataclass
class Page:
    """Elements and paths are numbered as they open, after their parents; number 0 of both is the page itself."""

    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    paths: list[int] = field(default_factory=lambda: [0])  # of each element
    above: list[int] = field(default_factory=lambda: [0])  # parent of each path
    marked: list[bool] = field(default_factory=lambda: [False])  # of each path: whether its last label is marked
    known: dict[tuple[int, str, bool], int] = field(default_factory=dict)

    def open(self, tag: str, parent: int, mark: bool) -> int:
        key = (self.paths[parent], tag, mark)
        if key not in self.known:
            self.known[key] = len(self.above)
            self.above.append(key[0])
            self.marked.append(mark)
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(self.known[key])
        return len(self.tags) - 1


def _kind(tag: str, attributes: str, within_main: bool) -> tuple[bool, bool]:
    """Whether an element is never main text, and whether its class or id marks it."""
    if tag in NEVER or tag == "header" and not within_main:
        return True, False
    mark = False
    if attributes and tag not in ("html", "body", "main", "article"):
        for name, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            if name.lower() == "role":
                if value in ROLES:
                    return True, False
                continue
            for token in value.split():
                words = set(_LETTERS.findall(token))
                odd = words - NEUTRAL
                mark = mark or bool(odd) and odd <= (WORDS if within_main else WORDS | {"header"})
    return False, mark


def read_page(source: str) -> Page:
    """The page's text blocks outside elements that are never main text."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # tag, innermost block element, left out, within main
    count: dict[str, int] = defaultdict(int)  # open elements by tag
    text: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal links
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            page.blocks.append(Block(joined, stack[-1][1] if stack else 0, links))
        text.clear()
        links = 0

    def close_to(place: int) -> None:
        if any(t in BLOCK for t, *_ in stack[place:]):
            end_block()
        for t, *_ in stack[place:]:
            count[t] -= 1
        del stack[place:]

    def add(piece: str) -> None:
        nonlocal links
        if piece and not (stack and stack[-1][2]):
            piece = html.unescape(piece)
            text.append(piece)
            if count["a"]:
                links += len(piece.strip())

    at, last = 0, source.rfind(">") + 1  # no tag ends after it: what opens there is text
    while (mark := _MARK.search(source, at, last)) is not None:
        add(source[at : mark.start()])
        at = mark.end()
        if mark.group() == "<!--":
            end = source.find("-->", at)
            at = len(source) if end < 0 else end + 3
            continue
        if mark.group(2) is None:
            continue
        tag = mark.group(2).lower()
        if mark.group(1):
            if count[tag]:
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place][0] == tag:
                        close_to(place)
                        break
                    if tag not in BLOCK and stack[place][0] in BLOCK:  # an inline end tag does not close a block
                        break
            elif tag == "p" or tag == "br":
                end_block()
            continue
        if tag in RAW:
            if not mark.group(3).rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*+>", re.IGNORECASE).search(source, at, last)
                at = len(source) if end is None else end.end()
            continue
        if tag in BLOCK:
            if tag != "br" and count["p"]:  # an open paragraph ends where a block begins
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place][0] == "p":
                        close_to(place)
                        break
                    if stack[place][0] in BLOCK:
                        break
            closes = CLOSES.get(tag, ())
            if any(count[t] for t in closes):
                for place in range(len(stack) - 1, -1, -1):
                    if stack[place][0] in closes:
                        close_to(place)
                        break
                    if stack[place][0] in HOLDERS:
                        break
            end_block()
        if tag not in VOID:
            _, holder, out, within = stack[-1] if stack else ("", 0, False, False)
            if not out:
                out, marked = _kind(tag, mark.group(3), within)
                if not out and (tag in BLOCK or marked):
                    holder = page.open(tag, holder, marked)
            stack.append((tag, holder, out, within or tag in ("article", "main")))
            count[tag] += 1
    add(source[at:])
    end_block()
    return page


def path_scores(page: Page, blocks: list[Block], top: int, smoothing: float) -> dict[int, float]:
    """The smoothed, fused score of every path from top down that some of the blocks are in or below."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])  # of a path and all below: text, punctuation, blocks, links
    own: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])  # of the path itself: text and links
    for b in blocks:
        path, linked = page.paths[b.element], min(b.links, len(b.text))
        for k, x in enumerate((len(b.text) - linked, len(_PUNCTUATION.findall(b.text)), 1, linked)):
            sums[path][k] += x
        own[path][0] += len(b.text)
        own[path][1] += linked
    for path in range(len(page.above) - 1, top, -1):
        if path in sums:
            for k, x in enumerate(sums[path]):
                sums[page.above[path]][k] += x
    smooth: dict[int, float] = {}
    weight: dict[int, float] = {}
    out: dict[int, float] = {}
    for path in sorted(p for p in sums if p >= top):
        length, marks, n, _ = sums[path]
        ratio = length / n * (1 + marks / n)
        parent = page.above[path]
        first = path == top
        smooth[path] = ratio if first else smoothing * smooth[parent] + (1 - smoothing) * ratio
        weight[path] = 1.0 if first else weight[parent] * (MARKED if page.marked[path] else 1.0)
        text, linked = own[path]
        out[path] = smooth[path] * weight[path] * (1 - linked / text if text else 1.0)
    return out


def select(page: Page) -> list[Block]:
    """The blocks of the main text."""
    blocks = page.blocks
    if not blocks:
        return []
    scores = path_scores(page, blocks, 0, PAGE_SMOOTHING)
    each = [scores[page.paths[b.element]] for b in blocks]
    mean = sum(each) / len(each)
    spread = (sum((x - mean) ** 2 for x in each) / len(each)) ** 0.5
    core = [x >= min(spread, mean) for x in each]
    held = [0] * len(page.tags)  # text of the core in each element
    for b, yes in zip(blocks, core):
        held[b.element] += len(b.text) * yes
    for n in range(len(held) - 1, 0, -1):
        held[page.parents[n]] += held[n]
    content = max(n for n in range(len(held)) if held[n] >= SHARE * held[0])  # of nested elements the innermost has the highest number
    chain = [content]
    while chain[-1]:
        chain.append(page.parents[chain[-1]])
    outer = [n for n in chain if page.tags[n] in ("article", "main")]
    if outer:
        content = outer[-1]
    elif page.tags[content] in BLOCK - HOLDERS and len(chain) > 1:  # one paragraph holds it all: its parent is the content element
        content = chain[1]
    within = [False] * len(page.tags)
    for n in range(len(within)):
        within[n] = n == content or n > 0 and within[page.parents[n]]
    inside = [b for b in blocks if within[b.element]]
    scores = path_scores(page, inside, page.paths[content], CONTENT_SMOOTHING)
    each = [scores[page.paths[b.element]] for b in inside]
    least = LEAST * sum(each) / max(1, len(each))
    return [b for b, x in zip(inside, each) if x >= least]


def main_text(source: str | None) -> str:
    return "\n".join(b.text for b in select(read_page(source or "")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_slices(picked, work, "page_id long, url string, text string, n_chars long", "html")
