"""A lenient DOM for main-text extraction: block elements and the text runs between their borders."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

# The element kinds of the HTML standard that matter here.
#: Elements whose content is no text of the page: code, the window's title, what a form field holds, what is never shown.
RAW = ("script", "style", "title", "textarea", "iframe", "template", "noframes")
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption button label".split()
)
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "select", "button", "label", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: A start tag of the key ends an open element of the value, up to the scope's border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
}
_P_BORDERS = ("td", "th", "table", "button", "caption")
_SKIPPED = (
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*+>(?:.*?</\1(?=[\s/>])[^>]*+(?:>|\Z)|.*\Z)"
)
_SKIP = re.compile(_SKIPPED, re.S | re.I)
_NAME = re.compile(r"<(/?)([a-z][^\s/>]*+)", re.I)
#: Attributes up to the first > in which every quote opens or ends a value.
_CLEAN = re.compile(r"(?:\s++[^\s\"'/=]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'=]++))?+)*+\s*+/?+")
#: The next thing in a tag: its end, or an attribute with an unquoted value, none, or (group 2) the quote that opens one.
_STEP = re.compile(r"[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:([\"'])|[^\s>\"'][^\s>]*+)?+)?+)")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|type|data-keep|data-drop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


class Node:
    """A block element, or (tag ``#text``) a text run of one."""

    __slots__ = ("tag", "tokens", "parent", "depth", "children", "text", "linked", "mark", "order", "stats")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None, mark: int | None = None):
        self.tag, self.tokens, self.parent, self.mark = tag, tokens, parent, mark
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.text, self.linked = "", 0
        self.stats = None
        if parent is not None:
            parent.children.append(self)


def _attributes(raw: str) -> tuple[tuple[str, ...], int | None]:
    tokens: dict[str, None] = {}
    mark = None
    if "=" in raw:
        for key, a, b, c in _ATTRIBUTE.findall(raw):
            key = key.lower()
            if key == "data-keep":
                mark = 1
            elif key == "data-drop":
                mark = 0
            elif key == "itemprop":
                tokens[f"itemprop:{(a or b or c).lower()}"] = None
            else:
                tokens.update((p.lower(), None) for p in _PART.findall(a or b or c))
    return tuple(tokens), mark


class _Open:
    """The open elements: a stack that also knows where each tag is open, so that no start tag walks it."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()

    def nearest(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def outermost_above(self, tags, border: int) -> int | None:
        """The place of the outermost open element of these tags inside the element at ``border``."""
        found = []
        for t in tags:
            places = self.at.get(t, ())
            k = bisect_right(places, border)
            if k < len(places):
                found.append(places[k])
        return min(found, default=None)


def _tag_end(page: str, at: int, lost: set[int]) -> int:
    """Where the tag ends whose name ends at ``at``: after the first > outside quoted values.

    A quote opens a value only straight after = and white space.  If a value's quote never comes again, or no > after the
    values, the tag ends at the first > of all, or at the page's end.  ``lost``: where values begin after which no end was
    found, so that no part of a page is searched again and again.
    """
    first = page.find(">", at)
    if first < 0 or _CLEAN.fullmatch(page, at, first):
        return first + 1 or len(page)
    opened, here = [], at
    while m := _STEP.match(page, here):
        here = m.end()
        if m[1]:
            return here
        if m[2]:
            if here in lost:
                break
            opened.append(here)
            here = page.find(m[2], here) + 1
            if not here:
                break
    lost.update(opened)
    return first + 1


def _tokens(page: str):
    """(start, end, tag, is an end tag, attributes) of the markup in page order; comments and the like have no tag."""
    at, lost = page.find("<"), set()
    while at >= 0:
        skipped = _SKIP.match(page, at)
        name = None if skipped else _NAME.match(page, at)
        if skipped:
            end = skipped.end()
            yield at, end, "", False, ""
        elif name:
            end = _tag_end(page, name.end(), lost)
            yield at, end, name[2].lower(), bool(name[1]), page[name.end() : end].removesuffix(">")
        else:  # a lone <
            end = at + 1
        at = page.find("<", end)


def parse(page: str) -> list[Node]:
    """All nodes in page order; the first is the root.  Scripts, styles and the like are no nodes.

    Time is linear in the page, however deep its elements are nested.
    """
    root = Node("#root", (), None)
    nodes, open_ = [root], _Open(root)
    stack = open_.stack
    parts: list[str] = []
    fields: dict[int, set[str]] = {}
    links = linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                run = Node("#text", (), stack[-1])
                run.text, run.linked = text, min(linked, len(text))
                nodes.append(run)
            parts.clear()
        linked = 0

    at = 0
    for start, stop, tag, end, raw in _tokens(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = stop
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag not in BLOCK:
            if tag == "a":
                links = 0 if end else 1
            elif tag in ("input", "img") and not end:
                has = fields.setdefault(id(stack[-1]), set())
                if tag not in has:
                    has.add(tag)
                    stack[-1].tokens += (f"has:{tag}",)
        elif end:
            if open_.at.get(tag):
                flush()
                links = 0
                open_.close_to(open_.at[tag][-1])
        else:
            flush()
            links = 0
            if tag in ("html", "body") and open_.at.get(tag):
                continue
            if tag in CLOSES_P and open_.at.get("p"):
                k = open_.at["p"][-1]
                if k > open_.nearest(_P_BORDERS):
                    open_.close_to(k)
            if tag in ENDS:
                ended, borders = ENDS[tag]
                lowest = open_.outermost_above(ended, open_.nearest(borders))
                if lowest is not None:
                    open_.close_to(lowest)
            tokens, mark = _attributes(raw)
            node = Node(tag, tokens, stack[-1], mark)
            nodes.append(node)
            if tag != "hr" and not raw.endswith("/") or tag in ("p", "div"):
                open_.push(node)
    if at < len(page):
        parts.append(page[at:])
        if links:
            linked += len(page) - at
    flush()
    return nodes
