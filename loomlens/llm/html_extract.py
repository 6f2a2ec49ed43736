"""HTML extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

The trees are trained here, on ``TRAINING_PAGES`` synthetic pages of a seeded generator (a bounded,
labelled sample; no page of any table is needed), by histogram boosting in numpy. Each element gets the
log-odds of being main text from its subtree's densities, attribute words, depth and siblings.

Decoding is joint: an element is outside, inside or cut out again, and a child of an outside element
may begin the inside, a child of the inside may be cut, and nothing below a cut can come back. The
labelling with the largest sum of log-odds under these rules is found by dynamic programming, so an
ancestor and its descendants never contradict each other.

Defined results: a null or empty page gives an empty text; broken or unclosed markup is closed where
HTML would close it; repeated rows are extracted each; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed
from .html_tree import BLOCK, SILENT, Node, blocks, parse

TRAINING_PAGES, ROUNDS, DEPTH, BINS, RATE = 600, 40, 4, 32, 0.3
#: Elements whose odds are worked out at once; pages are parsed until there are so many, or one has more.
ROWS_AT_ONCE = 4096
GOOD = ("article", "content", "post", "entry", "story", "main", "body", "text")
BAD = {
    "navigation": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager skip toc tabs".split(),
    "edge": "header footer masthead topbar bottom copyright colophon banner contentinfo sitemap".split(),
    "side": "sidebar aside side widget widgets related recommended recirc more trending popular complementary promo".split(),
    "advert": "ad ads adv advert advertisement sponsor sponsored promoted dfp adsense outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription dialog toast paywall warning".split(),
    "talk": "comment comments reply replies disqus respond discussion reader readers feedback".split(),
    "form": "form search login signup share social sharing follow tags tag meta byline".split(),
}
TAGS = "html body main article section nav header footer aside div p h1 h2 h3 ul ol li a form table td figure blockquote pre span b details dialog".split()
FEATURES = len(TAGS) + len(GOOD) + len(BAD) * 2 + 18
CLOSED = frozenset("form nav button select dialog fieldset".split())


def features(nodes: list[Node]) -> np.ndarray:
    """One row an element: tag, attribute words (own and inherited), subtree statistics, place."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    up = np.array([at[id(x.parent)] if x.parent is not None else 0 for x in nodes])
    own, own_link, punct, blocks_, paras, items, elements = (np.zeros(n) for _ in range(7))
    for i, x in enumerate(nodes):
        if x.tag in SILENT:
            continue
        for c in x.children:
            if isinstance(c, str):
                t = len(c.strip())
                own[i] += t
                punct[i] += sum(map(c.count, ".,;:!?"))
        elements[i], blocks_[i], paras[i], items[i] = 1, x.tag in BLOCK, x.tag == "p", x.tag == "li"
    in_link = np.zeros(n, bool)
    total, marks, n_blocks, n_paras, n_items, n_elements = own.copy(), punct.copy(), blocks_.copy(), paras.copy(), items.copy(), elements.copy()
    out = np.zeros((n, FEATURES), np.float32)
    good, bad, closed = np.zeros((n, len(GOOD)), bool), np.zeros((n, len(BAD)), bool), np.zeros(n, bool)
    for i, x in enumerate(nodes):
        p = up[i]
        in_link[i] = x.tag == "a" or (i > 0 and in_link[p])
        words = set(x.tokens())
        good[i] = [g in words for g in GOOD]
        bad[i] = [not words.isdisjoint(b) for b in BAD.values()]
        closed[i] = x.tag in CLOSED or (i > 0 and closed[p])
        if x.tag in TAGS:
            out[i, TAGS.index(x.tag)] = 1
    own_link[:] = np.where(in_link, own, 0)
    linked = own_link.copy()
    above = bad.copy()
    for i in range(n - 1, 0, -1):
        for a in (total, marks, n_blocks, n_paras, n_items, n_elements, linked):
            a[up[i]] += a[i]
    inside_article = np.zeros(n, bool)
    for i in range(1, n):
        above[i] |= above[up[i]]
        inside_article[i] = inside_article[up[i]] or nodes[i].tag in ("article", "main")
    whole = max(1.0, total[0])
    k = len(TAGS)
    out[:, k : k + len(GOOD)] = good
    k += len(GOOD)
    out[:, k : k + len(BAD)], out[:, k + len(BAD) : k + 2 * len(BAD)] = bad, above
    k += 2 * len(BAD)
    depth = np.array([x.depth for x in nodes])
    kids = np.array([sum(not isinstance(c, str) for c in x.children) for x in nodes])
    before = np.zeros(n)
    run = 0.0
    for i in range(n):
        before[i] = run
        run += own[i]
    extra = [
        np.log1p(total), np.log1p(own), total / np.maximum(1, n_elements), linked / np.maximum(1, total), marks / np.maximum(1, total),
        np.log1p(n_paras), np.log1p(n_items), np.log1p(n_blocks), total / whole, before / whole, depth, np.log1p(kids),
        np.array([x.index for x in nodes]) / np.maximum(1, kids[up]), kids[up], total / np.maximum(1, total[up]),
        linked[up] / np.maximum(1, total[up]), inside_article, closed,
    ]
    for j, e in enumerate(extra):
        out[:, k + j] = e
    return out


class Boosted:
    """Histogram gradient boosting with logistic loss; trees of fixed depth as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self.bin(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self.leaf(binned, tree)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int16)

    @staticmethod
    def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << DEPTH) - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(1 << DEPTH)
        place = np.zeros(len(g), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(place == node)
            if len(rows):
                best = 1e-3
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(b.shape[1]):
                    gl = np.cumsum(np.bincount(b[rows, j], g[rows], BINS + 1))[:-1]
                    hl = np.cumsum(np.bincount(b[rows, j], h[rows], BINS + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < 1) | (hs - hl < 1)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], j, k
                place[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        leaf = place - inner
        gl, hl = np.bincount(leaf, g, 1 << DEPTH), np.bincount(leaf, h, 1 << DEPTH)
        value = RATE * gl / (hl + 1)
        return feature, cut, value

    @staticmethod
    def leaf(b: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, value = tree
        place, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            place = 2 * place + 1 + (b[rows, feature[place]] > cut[place])
        return value[place - ((1 << DEPTH) - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """All trees step down together, some thousand rows at a time."""
        feature, cut, value = (np.stack(a) for a in zip(*self.trees, strict=True))
        b, tree, out = self.bin(x), np.arange(len(feature))[:, None], []
        for i in range(0, len(b), ROWS_AT_ONCE):
            part = b[i : i + ROWS_AT_ONCE]
            rows, place = np.arange(len(part)), np.zeros((len(feature), len(part)), np.int64)
            for _ in range(DEPTH):
                place = 2 * place + 1 + (part[rows, feature[tree, place]] > cut[tree, place])
            out.append(value[tree, place - feature.shape[1]].sum(axis=0))
        return self.base + np.concatenate([np.zeros(0), *out])


# --- the labelled sample ------------------------------------------------------------------------


def _sentence(r: random.Random, lo: int = 4, hi: int = 18) -> str:
    words = ["".join(r.choice(("ka", "lo", "mi", "ren", "tu", "sha", "ver", "on", "the", "ä", "é", "ing")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
    return " ".join(words).capitalize() + r.choice((".", ".", "!", "?", ", &amp; more."))


def _title(r: random.Random, lo: int, hi: int) -> str:
    """A heading or a link: mostly without a mark at its end."""
    t = _sentence(r, lo, hi)
    return t.rstrip(".!?") if r.random() < 0.7 else t


def _para(r: random.Random) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(1, 7)))


def _links(r: random.Random) -> str:
    li = "".join(f'<li><a href="/{r.random()}">{_title(r, 1, 4)}</a></li>' for _ in range(r.randint(3, 9)))
    return f"<ul>{li}</ul>" if r.random() < 0.8 else re.sub(r"</?li>", " ", li)


def _junk(r: random.Random, kind: str) -> str:
    word = r.choice(BAD[kind])
    attr = r.choice((f' class="{word}"', f' id="{word}"', f' class="{r.choice(("block", "box", "x1", "wrap"))} {word}-{r.choice(("box", "area", "inner", "1"))}"', f' role="{word}"'))
    body = {
        "navigation": lambda: _links(r), "edge": lambda: f"&copy; {_sentence(r)} &middot; {_sentence(r)}" if r.random() < 0.5 else f"<p>{_sentence(r)}</p>{_links(r)}",
        "side": lambda: f"<h3>{_sentence(r, 1, 3)}</h3>" + (_links(r) if r.random() < 0.6 else f"<p>{_para(r)}</p>"),
        "advert": lambda: _sentence(r) if r.random() < 0.5 else f"<p>{_para(r)}</p>", "notice": lambda: f"<p>{_para(r)}</p><button>OK</button>" if r.random() < 0.6 else _sentence(r),
        "talk": lambda: f"<h3>{_sentence(r, 1, 2)}</h3>" + "".join(f'<div class="comment"><b>{_sentence(r, 1, 2)}</b><p>{_para(r)}</p></div>' for _ in range(r.randint(1, 5))),
        "form": lambda: f"<label>{_sentence(r, 1, 3)}</label><input name=q><button>{_sentence(r, 1, 2)}</button>",
    }[kind]()
    tag = {"navigation": ("nav", "div", "ul"), "edge": ("footer", "header", "div"), "side": ("aside", "div", "section"), "form": ("form", "div")}.get(kind, ("div", "section", "aside"))
    tag = r.choice(tag)
    if tag in ("nav", "footer", "aside", "form") and r.random() < 0.6:
        attr = ""
    return f"<{tag}{attr}>{body}</{tag}>"


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_title(r, 2, 9)}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.randint(1, 14)):
        k = r.random()
        if k < 0.68:
            parts.append(f"<p>{_para(r)}</p>")
        elif k < 0.76:
            parts.append(f"<p><b>{_sentence(r)}<br>")
        elif k < 0.82:
            parts.append(f"<h2>{_title(r, 2, 6)}</h2>")
        elif k < 0.87:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif k < 0.90:
            parts.append(f"<blockquote>{_para(r)}</blockquote>")
        elif k < 0.92:
            parts.append(f"<table><tr><td>{_sentence(r, 1, 3)}</td><td>{_sentence(r, 1, 3)}</td></tr></table>")
        elif k < 0.95:
            parts.append(f"<div>{_para(r)}</div>")
        else:
            parts.append(f'<p>{_sentence(r)} <a href="/x">{_sentence(r, 1, 3)}</a> <em>{_sentence(r)}</em></p>')
    for kind in BAD:
        if r.random() < 0.08:
            parts.insert(r.randint(0, len(parts)), "\0" + _junk(r, kind) + "\1")
    return "".join(parts)


def sample_page(r: random.Random) -> str:
    """A page with \\2 ... \\3 around the main text and \\0 ... \\1 around what is cut out of it."""
    tag, attr = r.choice((("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", f' class="{r.choice(GOOD)}"'), ("div", f' id="{r.choice(GOOD)}"'), ("div", f' class="{r.choice(GOOD)}-{r.choice(GOOD)}"'), ("section", f' class="{r.choice(GOOD)}"'), ("div", "")))
    main = f"<{tag}{attr}>\2{_article(r)}\3</{tag}>"
    if r.random() < 0.3:
        main = f'<div class="{r.choice(("wrap", "container", "page", "row", "main"))}">{main}{_junk(r, "side") if r.random() < 0.5 else ""}</div>'
    head = [_junk(r, k) for k in ("navigation", "edge", "advert", "notice", "form") if r.random() < 0.45]
    tail = [_junk(r, k) for k in ("talk", "side", "advert", "edge", "form", "navigation", "notice") if r.random() < 0.35]
    r.shuffle(head)
    if r.random() < 0.15:  # a fragment
        return f"{''.join(head[:1])}{main}{''.join(tail[:2])}"
    page = f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title><style>p{{}}</style></head><body>{''.join(head)}{main}{''.join(tail)}"
    if r.random() < 0.1:
        return page[: r.randint(len(page) // 2, len(page))]
    return page + "</body></html>"


def labelled(page: str) -> tuple[list[Node], np.ndarray]:
    """The elements of a sample page and whether each one's text is main."""
    root, nodes = parse(page)
    state, cut = False, 0
    truth = {}

    def visit(node: Node) -> None:
        nonlocal state, cut
        begun, seen = (state, cut), False
        texts = []
        for c in node.children:
            if isinstance(c, str):
                for ch in c:
                    if ch in "\0\1\2\3":
                        state, cut, seen = {"\2": True, "\3": False}.get(ch, state), cut + {"\0": 1, "\1": -1}.get(ch, 0), seen or ch in "\2\3"
                    elif not ch.isspace():
                        texts.append(state and not cut)
            else:
                visit(c)
        truth[id(node)] = seen or (begun[0] and not begun[1])
        del texts

    visit(root)
    for x in nodes:
        x.children = [re.sub("[\0-\3]", "", c) if isinstance(c, str) else c for c in x.children]
    return nodes, np.array([truth[id(x)] for x in nodes])


@lru_cache(maxsize=1)
def model(pages: int = TRAINING_PAGES, seed: int = 7) -> Boosted:
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        nodes, y = labelled(sample_page(r))
        xs.append(features(nodes)), ys.append(y)
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


# --- decoding -----------------------------------------------------------------------------------

OUT, IN, CUT = 0, 1, 2


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """State of each element under the best consistent labelling."""
    n = len(nodes)
    at = {id(x): i for i, x in enumerate(nodes)}
    up = [at[id(x.parent)] if x.parent is not None else -1 for x in nodes]
    gain = np.stack([-odds, odds, -odds], axis=1)
    for i in range(n - 1, 0, -1):  # children come after their parents
        g, p = gain[i], gain[up[i]]
        p[OUT] += max(g[OUT], g[IN])
        p[IN] += max(g[IN], g[CUT])
        p[CUT] += g[CUT]
    state = np.zeros(n, np.int64)
    state[0] = OUT if gain[0][OUT] >= gain[0][IN] else IN
    for i in range(1, n):
        above, g = state[up[i]], gain[i]
        state[i] = CUT if above == CUT else (IN if g[IN] > g[OUT] else OUT) if above == OUT else (IN if g[IN] >= g[CUT] else CUT)
    return state


def extract_all(sources: Iterable[str | None], trees: Boosted) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    held: list[tuple[int, Node, list[Node]]] = []
    size = 0

    def settle() -> None:
        if not held:
            return
        odds = np.clip(trees.log_odds(np.concatenate([features(nodes) for _, _, nodes in held])), -6, 6)
        for at, root, nodes in held:
            own, odds = odds[: len(nodes)], odds[len(nodes) :]
            own[[x.tag in SILENT for x in nodes]] = 0
            inside = {id(x) for x, s in zip(nodes, decode(nodes, own), strict=True) if s == IN}
            out[at] = "\n\n".join(blocks(root, lambda node, inside=inside: id(node) in inside))
        held.clear()

    for at, source in enumerate(sources):
        out.append("")
        if source:
            held.append((at, *parse(source)))
            size += len(held[-1][2])
            if size >= ROWS_AT_ONCE:
                settle()
                size = 0
    settle()
    return out


def extract(source: str | None, trees: Boosted) -> str:
    return extract_all([source], trees)[0]


def html_extract(pages: DataFrame, html_col: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """Kept columns, ``text`` (main text, blocks joined by two newlines)."""
    src = narrowed(pages, *keep, html_col)
    trees = model()  # trained once on the driver; about 10 KB travel with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract_all((x.as_py() for x in batch.column(len(keep))), trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"])

    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{schema}, text string")


def op8(spark, sf_dir: str) -> DataFrame:
    out = html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
