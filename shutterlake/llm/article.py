r"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks; each block has the path of elements from the root to it. For each path the text
length and the punctuation of all its blocks are added up. The ratios per block of the path are smoothed over the page
with a Gaussian, since a heading or a short line between paragraphs belongs to them, and fused by multiplication. What a
path says of its role is a factor on the fused score: blocks below an element that a class or id names boilerplate weigh
little, and blocks outside an article or main element the less, the more of the page's text stands inside one; a teaser
in an article hardly counts against a page's text elsewhere. Blocks below navigation, form and similar elements count nothing,
unless such an element holds the only article or most of the page's text: then its role is ignored, or weighs like
a name if an article stands elsewhere. Paths whose score
reaches a share of the page's mean are content, within an article as outside, and the blocks of these paths, in page order, are the text.

Pages are independent of each other, so this runs as one pass of Arrow batches without a shuffle; state is one page. A page
is read in time that grows with its length, whatever its markup: open quotes, deep nesting, tags that close nothing.

Edge cases: null, empty and markup-less pages, unclosed and stray tags, and unknown references are all read as browsers
do in the main; a page without a content path has an empty text; repeated rows give equal results; an empty table gives
an empty result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shutterlake.llm.common import slices, table

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml title textarea select option object canvas xmp".split())
OUTSIDE = frozenset("head nav header footer aside form button menu dialog figure".split())
PREFERRED = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var ruby rb rt rp nobr wbr "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced menclose "
    "mmultiscripts mpadded mphantom mstyle merror mtable mtr mtd".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul figure".split()
)
# Words in class, id and role attributes that tell boilerplate or content.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "pager paywall popup promo promoted promotion recommended related replies respond search share sharing sidebar side "
    "signup skip social sponsor sponsored sponsors subscribe tags toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody body-text content entry entry-content main maincontent post post-body story".split())

#: Factor on the score of blocks that a name tells boilerplate.
NAMED = 0.05

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_RAW_ENDS = {name: re.compile(rf"</{name}[^>]*>?", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_PUNCTUATION = ".,;:!?…。，；：！？、"


def role(name: str, attributes: str) -> int:
    """-1 for an element outside the main text, -2 for one that a name tells boilerplate, 1 for one that names itself content, else 0."""
    if name in OUTSIDE:
        return -1
    found = 1 if name in PREFERRED else 0
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return -1
            if key not in ("class", "id", "role", "itemprop"):
                continue
            tokens = value.split()
            if any(t in CONTENT_WORDS for t in tokens):
                found = 1
            elif name not in ("html", "body") and found != 1 and any(map(_boilerplate, tokens)):
                found = -2
    return found


def _boilerplate(token: str) -> bool:
    """Whether all words of a class or id tell boilerplate."""
    found = _WORD.findall(token)
    return bool(found) and all(w in BOILERPLATE_WORDS for w in found)


class Tags:
    """The tags and comments of a page, each found in time that grows with its length.

    `match` is asked at places that only move on. A quote that opened in an attempt that failed is remembered: an
    attempt that comes to it again fails too. So a page of open quotes is read once, not once per tag.
    """

    def __init__(self, page: str):
        self.page = page
        self.failed: set[int] = set()
        self.last = {q: page.rfind(q) for q in "\"'"}
        self._next: dict[re.Pattern, int] = {}

    def _after(self, pattern: re.Pattern, at: int) -> int:
        """The first place from `at` on that a pattern of one character matches; the page's end if there is none."""
        if self._next.get(pattern, -1) < at:
            found = pattern.search(self.page, at)
            self._next[pattern] = found.start() if found else len(self.page)
        return self._next[pattern]

    def match(self, at: int) -> tuple[int, str, bool, str] | None:
        """(end, name, whether it closes, attributes) of the tag at a place; no name is a comment."""
        comment = _COMMENT.match(self.page, at)
        if comment:
            return comment.end(), "", False, ""
        tag = _TAG.match(self.page, at)
        if not tag:
            return None
        name_end = self._after(_NAME_END, tag.end())
        end, opened = self._after(_SPECIAL, name_end), []
        while end < len(self.page) and self.page[end] != ">":
            quote = self.page[end]
            if end in self.failed or end >= self.last[quote]:
                end = len(self.page)
                break
            opened.append(end)
            close = self.page.index(quote, end + 1)
            found = _SPECIAL.search(self.page, close + 1)
            end = found.start() if found else len(self.page)
        if end == len(self.page):
            self.failed.update(opened)
            return None
        return end + 1, self.page[tag.end() - 1:name_end].lower(), bool(tag[1]), self.page[name_end:end]


class _Open:
    """The open elements of a page: a stack, and for each name where on it that element is open."""

    def __init__(self):
        self.stack: list[_Element] = []
        self.places: dict[str, list[int]] = {}
        # Where elements are open that are not inline, and those that no paragraph or cell ends across.
        self.blocks: list[int] = []
        self.barriers: list[int] = []

    def push(self, element: _Element) -> None:
        at, name = len(self.stack), element.name
        self.stack.append(element)
        self.places.setdefault(name, []).append(at)
        if name not in INLINE:
            self.blocks.append(at)
            if name not in ("p", "thead", "tbody"):
                self.barriers.append(at)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop().name].pop()
        for places in (self.blocks, self.barriers):
            while places and places[-1] >= depth:
                places.pop()

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def top(self, places: list[int]) -> int:
        return places[-1] if places else -1


class _Element:
    """An open element: its path, the innermost element with a negative role that holds it, and what it says of content."""

    __slots__ = ("below", "inside", "linked", "name", "near", "path")

    def __init__(self, name: str, path: int, below: int, inside: bool, near: bool, linked: bool):
        # inside: below content; near: nearer to it than to any element with a negative role; linked: below a link.
        self.name, self.path, self.below, self.inside, self.near, self.linked = name, path, below, inside, near, linked


#: What holds an element that nothing holds.
_NOTHING = _Element("", 0, -1, False, False, False)
#: A path is (number of the parent's path, name); path 0 is empty.
Path = tuple[int, str]
#: Elements that a tag of their own kind ends.
_ENDS = {name: (name,) for name in ("li", "option", "tr", "td", "th")} | {"dt": ("dt", "dd"), "dd": ("dt", "dd")}


def blocks(page: str) -> tuple[list[tuple[int, int, str, int]], list[Path]]:
    """(number of the path, role, text, length of link text) of the page's blocks in order, and the paths."""
    tags = Tags(page)
    out: list[tuple[int, int, bool, str, int]] = []
    paths: list[Path] = [(-1, "")]
    numbers: dict[Path, int] = {}
    elements = _Open()
    stack = elements.stack
    # Elements with a negative role: (the one that holds it, role).
    roles: list[tuple[int, int]] = []
    articles: list[int] = []
    parts: list[str] = []
    links = 0
    at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                own = stack[-1] if stack else _NOTHING
                out.append((own.path, own.below, own.inside, text, links))
            parts.clear()
        links = 0

    def pop(depth: int) -> None:
        if elements.top(elements.blocks) >= depth:
            flush()
        elements.cut(depth)

    def text_to(end: int) -> None:
        nonlocal links
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if stack and stack[-1].linked:
                links += len(piece)

    opening = page.find("<")
    while opening >= 0:
        tag = tags.match(opening)
        if not tag:
            opening = page.find("<", opening + 1)
            continue
        text_to(opening)
        at, name, closes, attributes = tag
        if name in RAW and not closes and not attributes.endswith("/"):
            end = _RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
        opening = page.find("<", at)
        if not name or name in RAW:
            continue
        if closes:
            depth = elements.last(name)
            if depth >= 0 and not (name in INLINE and elements.top(elements.blocks) > depth):
                pop(depth)
            elif name == "p" or name not in INLINE:
                flush()
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            if name == "body" and elements.last("head") >= 0:
                elements.cut(elements.places["head"][0])
            # Inline elements left open do not reach into the next block, and some blocks end others.
            closing = ("p",) if name in CLOSES_PARAGRAPH else _ENDS.get(name, ())
            last = max((elements.last(c) for c in closing), default=-1)
            if last >= 0 and last >= elements.top(elements.barriers):
                pop(last)
        if attributes.endswith("/") and name not in INLINE:
            continue
        own, holder = role(name, attributes), stack[-1] if stack else _NOTHING
        below, path = holder.below, holder.path
        # Within an article, a header or figure belongs to it; menus, adverts and comments do not.
        if own < 0 and holder.near and name in ("header", "figure"):
            own = 0
        if own < 0:
            roles.append((below, own))
            below = len(roles) - 1
        if name in PREFERRED:
            articles.append(below)
        if name not in INLINE:
            path = numbers.setdefault((path, name), len(paths))
            if path == len(paths):
                paths.append((holder.path, name))
        elements.push(_Element(name, path, below, holder.inside or own > 0, own > 0 or holder.near and own == 0, holder.linked or name == "a"))
    text_to(len(page))
    flush()
    return _with_roles(out, roles, articles), paths


def _with_roles(found: list[tuple[int, int, bool, str, int]], roles: list[tuple[int, int]], articles: list[int]) -> list[tuple[int, int, str, int]]:
    """The blocks with their roles; an element with most of the page's text or its only articles is not left out.

    It has no role then, or that of a named one if an article stands outside all such elements. What an element holds is
    added up from the inner ones outwards, and what a block is left out by is carried inwards.
    """
    held = [0] * len(roles)
    total = 0
    for _, below, _, text, links in found:
        total += max(0, len(text) - links)
        if below >= 0:
            held[below] += max(0, len(text) - links)
    for k in range(len(roles) - 1, -1, -1):
        if roles[k][0] >= 0:
            held[roles[k][0]] += held[k]
    kinds = [r for _, r in roles]
    spared = [2 * n > total for n in held]
    if any(below < 0 for below in articles):
        kinds, spared = [-2 if s else r for s, r in zip(spared, kinds)], [False] * len(roles)
    else:
        holds = [False] * len(roles)
        for below in articles:
            holds[below] = True
        for k in range(len(roles) - 1, -1, -1):
            spared[k] = spared[k] or holds[k]
            if holds[k] and roles[k][0] >= 0:
                holds[roles[k][0]] = True
    left = []  # the strongest role that is left of an element and those around it; 0 is none
    for k, (around, _) in enumerate(roles):
        outer = left[around] if around >= 0 else 0
        own = 0 if spared[k] else kinds[k]
        left.append(-1 if -1 in (outer, own) else min(outer, own))
    return [(path, left[below] if below >= 0 and left[below] else int(inside), text, links) for path, below, inside, text, links in found]


def content(found: list[tuple[int, int, str, int]], paths: list[Path], threshold: float = 0.15, spread: float = 1.0) -> list[bool]:
    """Which blocks are content, by the fused and smoothed ratios of their paths."""
    if not found:
        return []
    lengths: dict[tuple[int, int], list[float]] = {}
    for path, kind, text, links in found:
        sums = lengths.setdefault((path, kind), [0.0, 0.0, 0.0, 0.0])
        sums[0] += max(0, len(text) - links) if kind != -1 else 0
        sums[1] += sum(map(text.count, _PUNCTUATION)) if kind != -1 else 0
        sums[2] += 1
        sums[3] += links / max(1, len(text))
    texts = [lengths[p, k][0] / lengths[p, k][2] for p, k, _, _ in found]
    marks = [lengths[p, k][1] / lengths[p, k][2] for p, k, _, _ in found]
    radius = int(2 * spread)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / spread) ** 2)
    kernel /= kernel.sum()

    def smooth(values: list[float]) -> np.ndarray:
        return np.convolve(values, kernel, "full")[radius:radius + len(values)]

    # A path whose blocks are links in the main is a menu.
    in_list = lambda path: paths[path][1] == "li" and paths[path][0] > 0
    menu = {key: sums[3] > 0.6 * sums[2] and (key[1] != 1 or in_list(key[0])) for key, sums in lengths.items()}
    inside = sum(sums[0] for (_, kind), sums in lengths.items() if kind == 1)
    beside = sum(sums[0] for (_, kind), sums in lengths.items() if kind == 0 and not menu[_, kind])
    plain = (beside / (inside + beside)) ** 2 if inside else 1.0
    factor = {1: 1.0, 0: plain, -1: 0.0, -2: NAMED * (1.0 if inside else plain)}
    weights = [0.0 if menu[p, k] else factor[k] for p, k, _, _ in found]
    fused = [w * t * (1 + m) for w, t, m in zip(weights, smooth(texts), smooth(marks))]
    by_path: dict[tuple[int, int], list[float]] = {}
    for (path, kind, _, _), score in zip(found, fused):
        by_path.setdefault((path, kind), []).append(score)
    scores = {key: sum(v) / len(v) for key, v in by_path.items()}
    # What weighs little says little of the page's mean.
    limit = threshold * sum(w * s for w, s in zip(weights, fused)) / (sum(weights) or 1.0)
    keep = [scores[p, k] > max(limit, 0.0) for p, k, _, _ in found]
    # A headline within an article stands or falls with the article's other blocks.
    heads = [k == 1 and paths[p][1] in HEADINGS for p, k, _, _ in found]
    others = [c for c, h, (_, k, _, _) in zip(keep, heads, found) if k == 1 and not h]
    return [any(others) if h and others else c for c, h in zip(keep, heads)]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    found, paths = blocks(page or "")
    return " ".join(b[2] for b, keep in zip(found, content(found, paths)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Main text per row of pages (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_main_text(spark, folder: str) -> DataFrame:
    """Main text of the whole `pages` table."""
    return extract(table(spark, folder, "pages"))
