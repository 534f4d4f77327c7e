"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import by_text

# HTML element names and the words by which page parts are named.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = set(
    "head nav aside footer form button select option datalist fieldset dialog menu svg math "
    "canvas audio video object applet map".split()
)
CONTENT = {"article", "main"}
PAGE = {"", "html", "body"}
NAMED = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login comment comments reply replies respond disqus share "
    "sharing social related recommended recommendations widget toolbar pagination pager "
    "search skip topbar".split()
)
ROLES = set("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
#: Elements that a start tag closes, up to the nearest of the second; tags and their group.
GROUPS = [
    ({"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dl"}),
    ({"tr", "td", "th"}, {"table"}),
    ({"td", "th"}, {"tr", "table"}),
]
CLOSES = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}

TAG = re.compile(
    r"<(?:!--(?P<note>.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!|;|$)")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？¿¡]")

#: Weights of a block's neighbours in page order, and the least share of the best path's score.
SMOOTHING, THRESHOLD = (1.0, 0.5, 0.25), 0.3
#: The main container holds so large a part of the text of content paths.
HELD = 0.8


class Element:
    """What is said of an element by its tag and by those around it, known when it opens.

    ``parent`` and ``number`` place it; elements are numbered as they open, so a parent has
    the smaller number. ``path`` is the number of its tag path on the page. ``closes`` has for
    each group of ``CLOSES`` the outermost open element that a tag of the group closes.
    """

    __slots__ = ("name", "parent", "number", "path", "dropped", "named", "words", "in_content", "part", "closes")

    def __init__(self, name, parent, number, path, dropped, named):
        self.name, self.parent, self.number, self.path = name, parent, number, path
        self.dropped, self.named = dropped, named
        around = parent is not None
        #: words of names around it, the page part below the body that it is in
        self.words = (parent.words | named if named else parent.words) if around else frozenset()
        self.in_content = name in CONTENT or around and parent.in_content
        self.part = None if name in PAGE else parent.part or self
        self.closes = tuple(
            None if name in limit else parent.closes[i] or self if name in closed else parent.closes[i]
            for i, (closed, limit) in enumerate(GROUPS)
        ) if around else (None,) * len(GROUPS)


class Page:
    """The open elements of a page, and all elements so far."""

    def __init__(self):
        self.elements: list[Element] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.top = self.root = self._add("", "", None, False, frozenset())
        #: how many elements of a name are open, in all and inside each open article
        self.open = [Counter()]

    def _add(self, name, mark, parent, dropped, named) -> Element:
        key = (-1 if parent is None else parent.path, mark)
        path = self.paths.setdefault(key, len(self.paths))
        element = Element(name, parent, len(self.elements), path, dropped, named)
        self.elements.append(element)
        return element

    def start(self, name: str, mark: str, dropped: bool, named: frozenset) -> None:
        self.top = self._add(name, mark, self.top, self.top.dropped or dropped, named)
        self.open[-1][name] += 1
        if name in CONTENT:
            self.open.append(Counter())

    def close(self, element: Element) -> None:
        """Close an open element and all inside it."""
        while True:
            top = self.top
            if top.name in CONTENT:
                self.open.pop()
            self.open[-1][top.name] -= 1
            self.top = top.parent
            if top is element:
                return

    def end(self, name: str) -> None:
        """An end tag; a stray one is passed over, and closes no article from inside it."""
        if name in CONTENT:
            if len(self.open) == 1:
                return
        elif not (sum(o[name] for o in self.open) if name in PAGE else self.open[-1][name]):
            return
        at = self.top
        while at.name != name:
            if at.name in CONTENT and name not in PAGE:
                return
            at = at.parent
        self.close(at)


def _hidden(key: str, value: str) -> bool:
    if key == "hidden":
        return value in ("", "hidden")
    return key == "aria-hidden" and value == "true" or key == "style" and bool(HIDDEN.search(value))


def _unwanted(name: str, rest: str, parent: Element) -> tuple[bool, set[str], str]:
    """(whether an element is no article text, words that name it so, its part of a tag path).

    The empty word stands for a name that says so alone: a first word, a role, a form.
    """
    if name in DROPPED and name != "form":
        return True, set(), name
    in_content = parent.in_content
    if name == "header" and not in_content:
        return True, set(), name
    mark, hidden, named = name, False, {""} if name == "form" else set()
    for key, value in ATTRIBUTE.findall(rest) if rest else ():
        key, value = key.lower(), value.strip("\"'").strip().lower()
        if key == "class":
            mark = f"{name}.{value}"
        if name in CONTENT or name in ("html", "body"):
            continue
        hidden |= _hidden(key, value)
        if key == "role" and value in ROLES:
            named.add("")
        if key not in ("class", "id"):
            continue
        for own in value.split():
            words = re.split(r"[^a-z]+", own)
            if words[0] not in ("has", "with", "no", "without", "is"):
                named |= NAMED.intersection(words[1:]) | ({""} if words[0] in NAMED else set())
            # an article's own header holds its title
            if words in (["header"], ["site", "header"], ["page", "header"]) and not in_content:
                named.add("")
    return hidden, named, mark


def page_blocks(html: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """(elements, blocks) of a page in page order, blocks as (element, text), without dropped parts.

    Parts that are only named like no article text are in it; see ``without_named``. Tolerates
    missing and stray end tags; formatting elements do not end a block.
    """
    page = Page()
    found, text, at, end = [], [], 0, len(html)

    def flush():
        block = " ".join("".join(text).split())
        if block and not page.top.dropped:
            found.append((page.top, block))
        text.clear()

    while at < end:
        tag = TAG.search(html, at)
        stop = tag.start() if tag else end
        if stop > at and not page.top.dropped:
            part = html[at:stop]
            text.append(unescape(part) if "&" in part else part)
        if tag is None:
            break
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not tag["end"] and not tag["rest"].endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = close.end() if close else end
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if tag["end"]:
            page.end(name)
            continue
        if page.top.name == "p":
            page.close(page.top)
        if name in CLOSES:
            closed = page.top.closes[CLOSES[name]]
            if closed is not None:
                page.close(closed)
        if name in VOID:
            continue
        unwanted, named, mark = _unwanted(name, tag["rest"], page.top)
        page.start(name, mark, unwanted, frozenset(named))
        if tag["rest"].endswith("/") and name not in ("p", "div"):
            page.close(page.top)
    flush()
    return page.elements, found


def path_scores(blocks: list[tuple[int, str]]) -> dict[int, float]:
    """How much the blocks (tag path, text) of each tag path read like an article.

    For each path: characters a block and punctuation marks a block, fused to one number.
    Blocks take on some of their neighbours' numbers; a path scores their mean.
    """
    sums: dict[int, list[int]] = {}
    for path, text in blocks:
        own = sums.setdefault(path, [0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(PUNCTUATION.findall(text))
    ratio = {p: math.log1p(size / n) * (1 + math.log1p(marks / n)) for p, (n, size, marks) in sums.items()}
    raw = [ratio[p] for p, _ in blocks]
    scores = dict.fromkeys(sums, 0.0)
    for i, (path, _) in enumerate(blocks):
        total = weight = 0.0
        for far, w in enumerate(SMOOTHING):
            for j in {i - far, i + far}:
                if 0 <= j < len(raw):
                    total, weight = total + w * raw[j], weight + w
        scores[path] += total / weight / sums[path][0]
    return scores


def content_paths(blocks: list[tuple[Element, str]]) -> set[int]:
    """The tag paths that reach a part of the best path's score."""
    scores = path_scores([(e.path, text) for e, text in blocks])
    best = max(scores.values(), default=0.0)
    return {p for p, s in scores.items() if s >= THRESHOLD * best}


def _held(elements: list[Element], blocks: list[tuple[Element, str]], chosen: set[int]) -> list[int]:
    """For each element the characters on content paths inside it."""
    held = [0] * len(elements)
    for e, text in blocks:
        if e.path in chosen:
            held[e.number] += len(text)
    for e in reversed(elements[1:]):
        held[e.parent.number] += held[e.number]
    return held


def without_named(elements: list[Element], blocks: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
    """The blocks outside parts whose name says that they are no article text.

    A name does not count if its part holds most of the text on content paths of the page, or
    if it is a later word of a class and all parts with that word together do; in either case
    only if no article or main element apart from it holds any.
    """
    if not any(e.words for e, _ in blocks):
        return blocks
    chosen = content_paths(blocks)
    held = _held(elements, blocks, chosen)
    shares = dict.fromkeys({w for e, _ in blocks for w in e.words} | {""}, 0)
    for e, text in blocks:
        if e.path in chosen:
            for word in e.words - {""}:
                shares[word] += len(text)
    most = HELD * held[0]
    marked = [e.name in CONTENT and not e.words and held[e.number] > 0 for e in elements]
    total, around, left_out = sum(marked), [0] * len(elements), [False] * len(elements)
    for e in elements[1:]:
        above = e.parent.number
        around[e.number] = around[above] + marked[e.number]
        left_out[e.number] = left_out[above]
        if e.named:
            holds = held[e.number] >= most or all(shares.get(w, 0) >= most for w in e.named)
            apart = around[e.number] < total  # an article that this part is not inside of
            left_out[e.number] |= apart or not holds
    return [(e, text) for e, text in blocks if not left_out[e.number]]


def main_text(html: str | None) -> str:
    """Blocks of the article, one a line; empty without any.

    Every block on a content path is taken, and so are the blocks between two such blocks if
    an element below the page's body holds all of them. Where one element holds most of the
    content paths' text, its other blocks are taken too, those at its ends included: the
    deepest such element, or the article or main element around it. Time and memory grow with
    the page, however deep its elements are.
    """
    elements, blocks = page_blocks(html or "")
    blocks = without_named(elements, blocks)
    if not blocks:
        return ""
    chosen = content_paths(blocks)
    held = _held(elements, blocks, chosen)
    depth = [0] * len(elements)
    for e in elements[1:]:
        depth[e.number] = depth[e.parent.number] + 1
    # among equals the last one opened: they hold each other
    container = max((e for e in elements if held[e.number] >= HELD * held[0]), key=lambda e: depth[e.number])
    if container.in_content:
        while container.name not in CONTENT or container.parent.in_content:
            container = container.parent
    elif any(e is container for e, _ in blocks) and container.parent:
        container = container.parent  # a block is no container
    inside = [False] * len(elements)
    if container.name not in PAGE:
        inside[container.number] = True
        for e in elements[container.number + 1 :]:
            inside[e.number] = inside[e.parent.number]
    taken = [e.path in chosen or inside[e.number] for e, _ in blocks]
    places = [i for i, own in enumerate(taken) if own]
    for i, j in zip(places, places[1:]):
        first, last = blocks[i][0].part, blocks[j][0].part
        if j > i + 1 and first is not None and first is last:
            taken[i:j] = [True] * (j - i)
    return "\n".join(text for (_, text), own in zip(blocks, taken) if own)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
    are left out; character references are decoded, white space inside a block is one space,
    blocks are joined by a line feed. n_chars counts code points. Null or empty html, or a
    page without text, gives an empty text and 0. Repeated rows and null ids come back as
    they are. Other columns are ignored; no pages give no rows. Memory: some times one page.
    """

    def run(batch):
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        columns.append(pa.array([len(t) for t in texts], pa.int64()))
        yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    return by_text(run, pages, "page_id long, url string, text string, n_chars long")
