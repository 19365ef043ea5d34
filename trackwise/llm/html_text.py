"""Main text of web pages by tag-path ratios.

A page is read once into leaf texts with their root-to-leaf tag paths; scripts, styles, comments and the like give none.
For each path the text length per node and the punctuation per node are aggregated, both are smoothed over paths that
follow each other on the page, fused by multiplication, and paths above the mean are content paths. The content region is
an article or main element if it holds them, else the innermost element that holds all texts on content paths, the h1
headings and more than one block. Inside it every block is kept, however short, except boilerplate: elements that are no
text by their tag, and subtrees that a class name, id or role calls so. Such a name is only a prior: it doesn't count for an
element that holds an article, a main element or an h1 (a wrapper), nor where all content paths would go with it; words for
parts of a page's frame (header, notice, search and so on) don't count inside an article.

Work and memory are in proportion to the page, whatever its depth and however broken: paths are numbers, flags are
inherited, sums go up once.

Defined results: null, empty or text-free pages give an empty text; broken and unfinished markup is read as far as it
goes, an unfinished tag at the end is dropped; very long and very deep pages are read whole; repeated rows give the same
text; of equally dense paths all count; an empty table gives an empty result. Only id, url and html are read, so other
columns may have any names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

_ATTRS = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(script|style|iframe|textarea|title|xmp|noembed|noframes)(?![^\s/>])(?:{_ATTRS})(?:>.*?(?:</\1(?![^\s/>])[^>]*>|\Z)|\Z)"
    r"|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
    rf"|<([a-zA-Z][^\s>/]*)({_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Element kinds, and words of class names and roles that mark boilerplate.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
DROP_TAGS = {"nav", "header", "footer", "aside", "form", "button", "input", "menu", "dialog", "head", "fieldset", "label", "noscript", "template", "svg", "math", "object", "select", "canvas", "video", "audio"}
DROP_WORDS = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "widget", "pagination", "pager", "complementary", "contentinfo", "skip", "hidden"}
FRAME_WORDS = {"banner", "footer", "header", "masthead", "topbar", "toolbar", "discussion", "notice", "notices", "alert", "search", "popular", "copyright", "legal", "disclaimer"}
NO_WORDS = {"has", "have", "with", "without", "no", "not", "is", "hide", "show"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PUNCT = re.compile(r"[.,;:!?。、，！？]")
_SPACE = re.compile(r"\s+")
CORE = {"article", "main"}
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_NEVER = {"html", "body"} | HEADINGS
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _boilerplate(attrs: str, inside: bool) -> bool:
    """Whether a class name, id or role says so; names such as has-sidebar say what else there is and don't count."""
    for value in _CLASS.findall(attrs):
        for name in value.strip("\"'").split():
            words = [w.lower() for w in _PARTS.split(name) if w]
            if words and words[0] not in NO_WORDS and any(w in DROP_WORDS or (not inside and w in FRAME_WORDS) for w in words):
                return True
    return False


class _Node:
    """An element: hard and soft say whether it is boilerplate by tag and by name, each inherited."""

    __slots__ = ("tag", "parent", "hard", "soft", "core", "path", "number")

    def __init__(self, tag, parent, hard, soft, path, number):
        self.tag, self.parent, self.path, self.number = tag, parent, path, number
        self.hard = hard or (parent.hard if parent else False)
        self.soft = soft
        self.core = tag in CORE or (parent.core if parent else False)


def _closed_by(tag: str) -> set[str]:
    """The open elements that an element ends."""
    return {"p"} if tag in CLOSES_P else _CLOSES.get(tag, set())


def read(page: str) -> tuple[list[_Node], list[tuple[_Node, int, str]]]:
    """All elements, parents first, and the leaf texts in page order: the node that holds each, the number of its block, its
    decoded text."""
    root = _Node("", None, False, False, 0, 0)
    nodes, stack, leaves, paths, block = [root], [root], [], {}, 0
    # Places in the stack of elements that are not inline, and how often each tag is open: of those, and of the inline
    # ones since the last of those. So that no end tag is looked for in vain.
    outer, open_outer, open_inner = [0], Counter(), [Counter()]

    def text(raw: str) -> None:
        if raw:
            leaves.append((stack[-1], block, _html.unescape(raw)))

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            if tag in INLINE:
                open_inner[-1][tag] -= 1
            else:
                outer.pop()
                open_inner.pop()
                open_outer[tag] -= 1

    at = 0
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt)
        if not m:  # a bare "<" is text
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in INLINE:
                if open_inner[-1][tag]:
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    cut(i)
                continue
            block += 1
            if open_outer[tag]:
                i = len(outer) - 1
                while stack[outer[i]].tag != tag:
                    i -= 1
                cut(outer[i])
        elif m[3]:
            if m.end() == len(page) and not m[0].endswith(">"):
                break  # an unfinished tag at the end
            tag, attrs = m[3].lower(), m[4] or ""
            if tag == "br":
                text(" ")
            if tag in VOID:
                block += tag == "hr"
                continue
            if tag not in INLINE:
                block += 1
                ends = _closed_by(tag)
                for i in reversed(outer[-2:]):  # a p can't hold another, so it is the last or the last but one
                    if stack[i].tag in ends:
                        cut(i)
                        break
                    if stack[i].tag != "p":
                        break
            if attrs.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
                continue
            up = stack[-1]
            hard = (tag in DROP_TAGS and not (tag == "header" and up.core)) or bool(attrs and _HIDDEN.search(attrs) and tag not in ("html", "body"))
            soft = bool(attrs) and tag not in _NEVER and _boilerplate(attrs, up.core)
            node = _Node(tag, up, hard, soft, paths.setdefault((up.path, tag), len(paths) + 1), len(nodes))
            nodes.append(node)
            stack.append(node)
            if tag in INLINE:
                open_inner[-1][tag] += 1
            else:
                outer.append(len(stack) - 1)
                open_outer[tag] += 1
                open_inner.append(Counter())
    return nodes, leaves


def _up(nodes: list[_Node], own: list, join) -> list:
    """For each element what its subtree has: join of its own value and its children's."""
    out = list(own)
    for node in reversed(nodes):
        if node.parent is not None:
            out[node.parent.number] = join(out[node.parent.number], out[node.number])
    return out


def _dropped(nodes: list[_Node], by_name: bool) -> list[bool]:
    """For each element whether it is boilerplate: by tag, and by name unless it wraps an article or the first heading."""
    wraps = _up(nodes, [not n.hard and (n.tag in CORE or n.tag == "h1") for n in nodes], lambda a, b: a or b) if by_name else []
    out = [False] * len(nodes)
    for n in nodes:
        out[n.number] = n.hard or (n.parent is not None and out[n.parent.number]) or (by_name and n.soft and not wraps[n.number])
    return out


def _smooth(xs: list[float]) -> list[float]:
    """Weights 1, 2, 1 over neighbours."""
    n = len(xs)
    return [(2 * x + (xs[i - 1] if i else x) + (xs[i + 1] if i + 1 < n else x)) / 4 for i, x in enumerate(xs)]


def content_paths(leaves: list[tuple[_Node, int, str]], dropped: list[bool]) -> set[int]:
    """Tag paths whose smoothed and fused ratio is above the mean."""
    order: dict[int, list[float]] = {}
    for node, _, text in leaves:
        body = text.strip()
        if body and not dropped[node.number]:
            got = order.setdefault(node.path, [0, 0, 0])
            got[0] += len(body)
            got[1] += len(_PUNCT.findall(body))
            got[2] += 1
    if not order:
        return set()
    length, punct = _smooth([a / n for a, _, n in order.values()]), _smooth([(b + 0.1) / n for _, b, n in order.values()])
    fused = [x * y for x, y in zip(length, punct, strict=True)]
    mean = sum(fused) / len(fused)
    return {p for p, x in zip(order, fused, strict=True) if x >= mean}


def extract(page: str | None) -> str:
    """The main text of one page."""
    nodes, leaves = read(page or "")
    for by_name in (True, False):
        dropped = _dropped(nodes, by_name)
        if paths := content_paths(leaves, dropped):
            break
    else:
        return ""
    own = [0] * len(nodes)
    for node, _, text in leaves:
        if node.path in paths and not dropped[node.number]:
            own[node.number] += len(text.strip())
    held = _up(nodes, own, lambda a, b: a + b)
    core = [n for n in nodes if n.tag in CORE and held[n.number] > 0]
    if core and max(held[n.number] for n in core) >= 0.3 * held[0]:
        # Several articles side by side are one region each; all that hold content count.
        region = {n.number for n in core}
    else:
        region = {_around(nodes, leaves, paths, dropped)}
    inside = [False] * len(nodes)
    for n in nodes:
        inside[n.number] = n.number in region or (n.parent is not None and inside[n.parent.number])
    blocks: dict[int, list[str]] = {}
    for node, block, text in leaves:
        if inside[node.number] and not dropped[node.number]:
            blocks.setdefault(block, []).append(text)
    out = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in out if x)


def _around(nodes: list[_Node], leaves: list[tuple[_Node, int, str]], paths: set[int], dropped: list[bool]) -> int:
    """The innermost element with all texts on content paths, the h1 headings and a second block, if the page has one."""
    titled = [False] * len(nodes)
    for n in nodes:
        titled[n.number] = n.tag == "h1" or (n.parent is not None and titled[n.parent.number])
    marks, span = [0] * len(nodes), [(len(leaves) * 2 + 2, -1)] * len(nodes)
    for node, block, text in leaves:
        if text.strip() and not dropped[node.number]:
            marks[node.number] += node.path in paths or titled[node.number]
            lo, hi = span[node.number]
            span[node.number] = (min(lo, block), max(hi, block))
    marks = _up(nodes, marks, lambda a, b: a + b)
    span = _up(nodes, span, lambda a, b: (min(a[0], b[0]), max(a[1], b[1])))
    got = max(n.number for n in nodes if marks[n.number] == marks[0])
    while nodes[got].parent is not None and span[got][0] >= span[got][1]:
        got = nodes[got].parent.number
    return got


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[html].alias("h")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
