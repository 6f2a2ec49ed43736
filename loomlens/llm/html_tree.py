"""A forgiving HTML reader: a tree of elements with their own text, enough to judge and to extract from."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: A quote counts behind an equals sign alone, and only if it is closed; else the tag ends at the next bracket.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
#: A slash that closes the element at once: it stands alone, and is not the end of a value.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; all but the last two hold no text of the page.
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title".split())
SILENT = RAW | frozenset("head select option button datalist audio video map".split())
BLOCK = frozenset(
    "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody "
    "tfoot tr blockquote pre figure figcaption form fieldset details summary address hr center dialog search hgroup legend".split()
)
_P_ENDS = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption"}
#: An open element that a start tag of these ends, unless one of the bounds lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
}
_SCOPE = frozenset("html body table td th caption button article section div main aside nav header footer li ul ol blockquote form".split())


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "index")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = 0 if parent is None else parent.depth + 1
        self.index = 0

    def tokens(self) -> list[str]:
        """Words of class, id, role and similar attributes, lower-cased."""
        out = []
        for m in ATTR.finditer(self.attrs):
            if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label", "itemtype"):
                out += re.findall(r"[a-z]+|[0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())
        return out


_TABLE = frozenset(("table", "td", "th", "body"))
#: End tags that may close an element outside the innermost table, cell or body.
_ACROSS = frozenset("table tr tbody thead tfoot body html div article section main".split())


class Open:
    """The elements that are open, with places by tag, so that no end tag has to climb."""

    def __init__(self, root: Node):
        self.path, self.at, self.scopes, self.tables = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        i = len(self.path)
        self.path.append(node)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in _SCOPE:
            self.scopes.append(i)
        if node.tag in _TABLE:
            self.tables.append(i)

    def cut(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        while len(self.path) > i:
            self.at[self.path.pop().tag].pop()
        for places in (self.scopes, self.tables):
            while places[-1] >= i:
                places.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0


def parse(source: str) -> tuple[Node, list[Node]]:
    """(root, all elements in page order), in time in proportion to the page."""
    root = Node("#root", "", None)
    nodes, at, open_ = [root], 0, Open(root)

    def text(upto: int) -> None:
        if upto > at:
            open_.path[-1].children.append(html.unescape(source[at:upto]))

    while m := TOKEN.search(source, at):
        text(m.start())
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, attrs = name.lower(), m[3] or ""
        if m[1]:
            i = open_.last(name)
            if i and (i >= open_.tables[-1] or name in _ACROSS):
                open_.cut(i)
            continue
        if name in _P_ENDS and open_.last("p") > open_.scopes[-1]:
            open_.cut(open_.last("p"))
        if name in IMPLIED:
            ends, bounds = IMPLIED[name]
            bound = max(open_.last(b) for b in bounds)
            inner = [places[k] for t in ends if (places := open_.at.get(t)) and (k := bisect_right(places, bound)) < len(places)]
            if inner:
                open_.cut(min(inner))
        top = open_.path[-1]
        node = Node(name, attrs, top)
        node.index = len(top.children)
        top.children.append(node)
        nodes.append(node)
        if name in VOID or SELF_CLOSED.search(attrs):
            continue
        if name in RAW and name not in ("svg", "math", "object", "noscript", "canvas"):
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        open_.push(node)
    text(len(source))
    return root, nodes


def blocks(root: Node, keep) -> list[str]:
    """Texts of blocks in page order: white space folded to one space; elements that ``keep`` refuses give none."""
    out, part = [], []

    def close() -> None:
        t = " ".join("".join(part).split(None))
        part.clear()
        if t:
            out.append(t)

    stack: list = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i < len(node.children):
            stack.append((node, i + 1))
            c = node.children[i]
            if isinstance(c, str):
                if keep(node):
                    part.append(c)
            elif c.tag == "br" or c.tag in ("td", "th"):
                part.append(" ")
                stack.append((c, 0))
            elif c.tag not in SILENT:
                if c.tag in BLOCK:
                    close()
                stack.append((c, 0))
        elif node.tag in BLOCK:
            close()
        elif node.tag in ("td", "th"):
            part.append(" ")
    close()
    return out
