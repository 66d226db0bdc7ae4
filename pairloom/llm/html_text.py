"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks, each with the path of structural tags
from the root (inline tags are left out); only what is no text at all (scripts,
styles and other raw content, hidden elements, buttons and option lists) is passed
over.  For each root-to-leaf path the text outside links, its share of the page's, and
the punctuation are aggregated over its blocks and fused into one ratio.  Ratios are
smoothed over neighbouring blocks in page order, a neighbour counting less the more
of its path is not shared, and averaged for each path.  What the tags,
roles and class names of a path's elements say (menu, header, footer, sidebar,
notice, advert, form, comments) enters as a factor, `PRIOR`: it weighs a path down
against others, but a page whose whole text lies in such elements keeps its text.
Paths that reach a share of the best are content paths, and so are paths that end in the
tag of a content path (a paragraph elsewhere) and whose blocks are about as full.

The text holds all blocks of content paths.  Of the elements that hold such blocks, other
elements come back by their own ratios: where most of their text is outside links (what is marked
counts by the factor), or where one of their paths reaches a small share of the best.  `article` and `main` are tags
like others; a `header` within an article or section is no page header.

Paths are nodes of a trie and elements point to their parents, so a page takes time
and memory in proportion to its length, however deep it is nested.

Defined results: a null or empty page gives an empty text; a page without tags is
one block; markup that is never closed runs to where the next block starts or
the page ends; repeated rows each come out; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
NO_TEXT = {"button", "select", "option", "dialog"}
MARKED_TAGS = {"nav", "header", "footer", "aside", "menu", "form", "fieldset"}
MARKED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
MARKED_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "alert", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "foot", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets",
}
LAYOUT_WORDS = {"has", "no", "with", "without", "two", "left", "right"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
KEEPS_P = {"p", *INLINE}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "p": {"div", "article", "section", "main", "body", "blockquote", "td", "th", "li"}}

#: Elements of one block of text; the element around them is the container.
LEAVES = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "blockquote", "pre"}

#: Share of the best path's smoothed ratio from which a path is content.
PATH_SHARE = 0.2
#: Share of the text of a content path's blocks from which those of another path with the same last tag are content.
DENSE_SHARE = 0.1
#: Share of it from which an element in a container of content comes back though its text is in links.
RETURN_SHARE = 0.01
#: Factor on the ratio of a path with a marked element.
PRIOR = 0.005

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，؟¿¡]")


def judge(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the element is shown as text at all, and whether its tag, role or class name marks it."""
    shown, marked = tag not in NO_TEXT, tag in MARKED_TAGS
    if not attributes or not attributes.strip(" /\t\r\n"):
        return shown, marked
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            shown = False
        elif name == "role":
            marked |= value.strip() in MARKED_ROLES
        elif name in ("class", "id") and tag not in ("html", "body"):
            for token in value.split():
                parts = [p for p in re.split(r"[-_]+", token) if p]
                marked |= bool(MARKED_NAMES.intersection(parts)) and not LAYOUT_WORDS.intersection(parts)
    return shown, marked


@dataclass
class Page:
    """Blocks of a page with its elements and paths; number 0 of each is the page itself."""

    #: (text, characters of it in links, element, path)
    blocks: list[tuple[str, int, int, int]] = field(default_factory=list)
    #: of each element: parent, deepest element from it upwards that can hold several blocks, whether it is marked
    parent: list[int] = field(default_factory=lambda: [0])
    container: list[int] = field(default_factory=lambda: [0])
    marked: list[bool] = field(default_factory=lambda: [False])
    #: of each path: the path above, number of tags, whether an element of it is marked
    above: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    weighed_down: list[bool] = field(default_factory=lambda: [False])
    #: last tag of each path
    leaf: list[str] = field(default_factory=lambda: [""])


def read(page: str) -> Page:
    out = Page()
    paths: dict[tuple[int, str, bool], int] = {}
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, hidden, element, path
    inline: list[tuple[str, int]] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    hidden, links, link_chars = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.blocks.append((text, link_chars, stack[-1][2], stack[-1][3]))
            pieces.clear()
        link_chars = 0

    def pop(depth: int) -> None:
        nonlocal hidden
        flush()
        while len(stack) > depth:
            tag, was_hidden, *_ = stack.pop()
            open_tags[tag] -= 1
            hidden -= was_hidden

    def end_inline(depth: int) -> None:
        nonlocal hidden, links
        while len(inline) > depth:
            tag, was_hidden = inline.pop()
            open_tags[tag] -= 1
            hidden -= was_hidden
            links -= tag == "a"

    def push(tag: str, was_hidden: bool, mark: bool) -> None:
        _, _, element, path = stack[-1]
        key = path, tag, mark
        if key not in paths:
            paths[key] = len(out.above)
            out.above.append(path)
            out.depth.append(out.depth[path] + 1)
            out.weighed_down.append(mark or out.weighed_down[path])
            out.leaf.append(tag)
        own = len(out.parent)
        out.parent.append(element)
        out.container.append(out.container[element] if tag in LEAVES else own)
        out.marked.append(mark)
        stack.append((tag, int(was_hidden), own, paths[key]))
        open_tags[tag] += 1

    def text_to(end: int) -> None:
        nonlocal link_chars
        if end > at and not hidden:
            pieces.append(page[at:end])
            if links:
                link_chars += end - at

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text_to(size)
            break
        text_to(found.start())
        at = found.end()
        close, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if open_tags[tag] > 0:
                held = inline if tag in INLINE else stack
                k = next(k for k in range(len(held) - 1, -1, -1) if held[k][0] == tag)
                if held is stack:
                    pop(k)
                end_inline(k if held is inline else 0)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not hidden and tag in ("br", "img", "input"):
                pieces.append(" ")
            continue
        shown, mark = judge(tag, attributes)
        if tag == "header" and open_tags["article"] + open_tags["section"] > 0:  # the headline of an article or a part of it
            mark = judge("div", attributes)[1]
        if tag in INLINE:
            if not attributes.rstrip().endswith("/"):
                # marked words within a line have no path of their own
                inline.append((tag, int(not shown or mark)))
                open_tags[tag] += 1
                hidden += not shown or mark
                links += tag == "a"
            continue
        flush()
        end_inline(0)
        ends = CLOSES.get(tag, set()) | (set() if tag in KEEPS_P else {"p"})
        if any(open_tags[t] > 0 for t in ends):
            scope = SCOPE.get(tag, SCOPE["p"])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    pop(k)
                    break
                if stack[k][0] in scope:
                    break
        if not attributes.rstrip().endswith("/") or tag in ("p", "div", "article", "section"):
            push(tag, not shown, mark)
            hidden += not shown
    flush()
    return out


def _nearness(page: Page, a: int, b: int) -> float:
    """1 for equal paths, a tenth for each tag of the longer path that the other does not share."""
    high, low = (a, b) if page.depth[a] >= page.depth[b] else (b, a)
    steps = page.depth[high] - page.depth[low]
    for _ in range(steps):
        high = page.above[high]
    while high != low:
        high, low, steps = page.above[high], page.above[low], steps + 1
    return 0.1 ** min(steps, 300)


def path_ratios(page: Page) -> tuple[dict[int, float], dict[int, float]]:
    """(text of a block and root of its punctuation, the part of the page's text) of each path that has blocks; text in links does not count."""
    sums: dict[int, list[float]] = {}
    for text, linked, _, path in page.blocks:
        own = sums.setdefault(path, [0, 0, 0])
        own[0] += 1
        own[1] += max(len(text) - linked, 0)
        own[2] += len(_PUNCTUATION.findall(text))
    whole = sum(plain for _, plain, _ in sums.values()) or 1
    prior = lambda p: PRIOR if page.weighed_down[p] else 1.0
    return {p: prior(p) * (plain / nodes) * (1 + marks / nodes) ** 0.5 for p, (nodes, plain, marks) in sums.items()}, {p: plain / whole for p, (_, plain, _) in sums.items()}


def path_scores(page: Page) -> dict[int, float]:
    """Smoothed fused ratio of each path that has blocks."""
    density, share = path_ratios(page)
    fused = {p: density[p] * share[p] for p in density}
    order = [p for *_, p in page.blocks]
    counts = Counter(order)
    near: dict[tuple[int, int], float] = {}
    total = dict.fromkeys(fused, 0.0)
    for k, path in enumerate(order):
        value, weight = 4 * fused[path], 4.0
        for other in (order[k - 1] if k else path, order[k + 1] if k + 1 < len(order) else path):
            if (path, other) not in near:
                near[path, other] = near[other, path] = _nearness(page, path, other)
            value += near[path, other] * fused[other]
            weight += near[path, other]
        total[path] += value / weight
    return {p: total[p] / counts[p] for p in fused}


def chosen_paths(page: Page, scores: dict[int, float]) -> set[int]:
    """Paths that reach a share of the best score, and those that end in the tag of one of them with blocks as full of text as a share of its own."""
    best = max(scores.values(), default=0)
    chosen = {p for p, x in scores.items() if x >= PATH_SHARE * best}
    density, _ = path_ratios(page)
    full: dict[str, float] = {}
    for p in chosen:
        full[page.leaf[p]] = max(full.get(page.leaf[p], 0), density[p])
    return chosen | {p for p in density if page.leaf[p] in LEAVES and page.leaf[p] in full and density[p] >= DENSE_SHARE * full[page.leaf[p]]}


def returning(page: Page, scores: dict[int, float]) -> list[bool]:
    """Of each element, whether it comes back where it stands in a container of content.

    Half of its text must stand outside links (a marked element's share is multiplied by `PRIOR`), or one of
    its paths must reach `RETURN_SHARE` of the best score (of an element that is not marked).
    """
    best, size = max(scores.values(), default=0), len(page.parent)
    length, plain, reached = [0] * size, [0.0] * size, [False] * size
    for text, linked, e, path in page.blocks:
        length[e] += len(text)
        plain[e] += max(len(text) - linked, 0)
        reached[e] |= scores[path] >= RETURN_SHARE * best
    for e in range(size - 1, 0, -1):  # children come after their parents
        above = page.parent[e]
        length[above] += length[e]
        plain[above] += plain[e]
        reached[above] |= reached[e]
    return [reached[e] and not page.marked[e] or (PRIOR if page.marked[e] else 1.0) * plain[e] >= 0.5 * length[e] for e in range(size)]


def content(page: Page) -> list[str]:
    scores = path_scores(page)
    chosen = chosen_paths(page, scores)
    containers = {page.container[e] for _, _, e, p in page.blocks if p in chosen}
    back = returning(page, scores)
    inside = [0 in containers]
    for e in range(1, len(page.parent)):  # parents come first
        inside.append(e in containers or inside[page.parent[e]] and back[e])
    return [text for text, _, e, p in page.blocks if p in chosen or inside[e]]


def main_text(page: str | None) -> str:
    return "\n".join(content(read(page))) if page else ""


@F.arrow_udf(StringType())
def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract_text(pages: DataFrame, *, page: str = "html", into: str = "text") -> DataFrame:
    """`pages` with the main text in column `into` (a column of that name is replaced)."""
    return pages.withColumn(into, _main_texts(F.col(page).cast("string")))
