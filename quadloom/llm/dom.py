"""A lenient HTML reader: a tree of block elements whose leaves are the text blocks in page order.

Inline elements don't split a block; ``br`` is white space. Open paragraphs, list items, cells and the like are closed by
what can't stand inside them; stray end tags, unfinished tags, comments and unknown elements do no harm. Scripts, styles,
the title, form controls with a text of their own and frames are left out; any other element is an ordinary one. For each
name the places of its open elements are kept, so a tag is handled in time logarithmic in the depth.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html import unescape

#: Element names by what the reader does with them.
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math meter mi mn mo mrow msub msup mfrac msqrt nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
DROPPED = frozenset("script style template iframe select datalist textarea title noframes".split())
#: Names that end the search for an open paragraph.
BARRIERS = ("table", "td", "th", "li", "div", "article", "section", "main", "body")
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in DROPPED}


@dataclass
class Tree:
    """Parallel lists by node; the root is node 0. Leaves have text, elements have features."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    attrs: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[float] = field(default_factory=lambda: [0.0])

    def add(self, parent: int, tag: str, attrs: str, text: str | None = None, linked: float = 0.0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        v = m[2] or ""
        out.setdefault(m[1].lower(), unescape(v[1:-1] if v[:1] in "\"'" and v else v))
    return out


def tokens(raw: str) -> frozenset[str]:
    """The words of an element's class, id, role and label, and whether it is hidden."""
    if not raw.strip(" /"):
        return frozenset()
    a = attributes(raw)
    found = {w for k in ("class", "id", "role", "aria-label", "itemprop") for w in _WORD.findall(_CAMEL.sub(" ", a.get(k, "")).lower())}
    style = a.get("style", "").replace(" ", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        found.add("#hidden")
    return frozenset(found)


def parse(html: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]
    places: dict[str, list[int]] = {}  # where in the stack elements of a name stand
    parts: list[str] = []
    link_depth, linked, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tree.add(stack[-1][1], stack[-1][0], "", text, min(1.0, linked / len(text)))
            parts.clear()
        linked = 0

    def close_to(k: int) -> None:
        flush()
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def innermost(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close_p() -> None:
        """A block element ends an open paragraph."""
        k = innermost(("p",))
        if k > innermost(BARRIERS):
            close_to(k)

    def say(piece: str) -> None:
        nonlocal linked
        piece = unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if link_depth:
            linked += len(piece)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        if lt > at:
            say(html[at:lt])
        m = _TAG.match(html, lt) or _LOOSE.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", lt):
                end = html.find("]]>", lt)
                at = n if end < 0 else end + 3
            elif lt + 1 < n and (html[lt + 1] in "!?" or html[lt + 1 : lt + 3].strip("/")[:1].isalpha() and html[lt + 1] != " "):
                end = html.find(">", lt)  # a declaration, or a tag that the page's end cuts off
                at = n if end < 0 else end + 1
            elif html.startswith("</", lt):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                say("<")
                at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            elif name == "br":
                parts.append(" ")
            elif name not in INLINE:
                if k := innermost((name,)):
                    close_to(k)
                elif name == "p":
                    flush()
            continue
        if name in DROPPED:
            if not m[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                end = _END[name].search(html, at)
                at = end.end() if end else n if name in ("script", "style") else at
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            link_depth += name == "a" and not m[3].endswith("/")
            continue
        if name in VOID:
            if name == "hr":
                flush()
                close_p()
            continue
        flush()
        if name not in ("html", "body", "head"):
            close_p()
        if name in CLOSES:
            shut, scope = CLOSES[name]
            within = innermost(scope)
            found = [x[k] for t in shut if (x := places.get(t)) and (k := bisect_right(x, within)) < len(x)]
            if found:
                close_to(min(found))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, tree.add(stack[-1][1], name, m[3])))
        link_depth = 0 if name in ("article", "main", "section", "footer", "nav", "aside") else link_depth
    flush()
    return tree
