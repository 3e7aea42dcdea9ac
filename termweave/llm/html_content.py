"""Operator 10: main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of elements and text blocks (runs of inline text of one
block element).  Every node has a hidden label, content or not.  How likely a child of a
content node is content, by tag, by the words of class, id and role and by the link share below
it, under another node, at the root, and what text blocks show (length, link share, ending,
a notice of rights) is learned from labelled pages; one upward and one
downward pass of sum-product messages give each text block's marginal, and
the blocks above one half are the text.

A page is one row, so the work is one pass over the scan with no shuffle; the
model is a few hundred numbers sent with the task.

Edge cases: null, empty or text-free pages give an empty text; markup that is
cut off or wrongly nested is read as far as it goes; repeated rows give equal
texts; an empty table gives an empty result; extra columns are kept, but for one whose
name a result takes.  Elements with the attribute ``hidden`` are not read, like scripts.  A
very long page is one row in one task: time and memory grow in proportion to its length,
also with unclosed elements and stray ends.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from termweave.llm.common import map_texts
from termweave.llm.labelled_pages import labelled_pages

# Weights tried for what text blocks show.
WEIGHTS = (0.1, 0.25, 0.5, 1.0)
# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s "
                   "samp small span strike strong sub sup time tt u var wbr "
                   "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics "
                   "annotation".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
             "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main body html".split())
# Words of class, id and role that page builders use, by what they announce.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "ad": "ad ads advert advertisement adverts banner promo promotion sponsor sponsored teaser",
    "head": "header masthead topbar logo brand",
    "foot": "footer copyright imprint colophon legal",
    "side": "aside sidebar related widget rail recommended complementary more",
    "talk": "comment comments reply replies respond discussion disqus reactions",
    "notice": "notice cookie cookies consent alert popup modal overlay gdpr warning message",
    "form": "form newsletter subscribe signup login search share social sharing",
    "main": "content article post entry main story text body",
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
_WORD = re.compile(r"[a-z]+")
_RIGHTS = re.compile(r"©|\bcopyright\b", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    hint: str = "-"
    mark: int | None = None  # label given by a labelled page
    text: list = field(default_factory=list)
    linked: int = 0
    unread: bool = False


class _Tree(HTMLParser):
    """Builds the tree.  The depths of the open elements are kept by tag, and those of
    blocks and scopes apart, so every tag finds its place without a walk of the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1)]
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]
        self.block: int | None = None
        self.unread = 0

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.nodes[self.stack.pop()]
            self.unread -= node.unread
            self.depths[node.tag].pop()
            if node.tag not in INLINE:
                self.block = None
                self.blocks.pop()
                if node.tag in SCOPE:
                    self.scopes.pop()

    def _open(self, *tags: str) -> bool:
        return any(self.depths.get(t) for t in tags)

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.block = None
            for closed in CLOSED_BY.get(tag, set()) | {"p"}:
                depths = self.depths.get(closed, ())
                at = bisect_right(depths, self.scopes[-1])
                if at < len(depths):
                    self._pop_to(depths[at])
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        given = dict(attrs)
        words = _WORD.findall(" ".join(given.get(k) or "" for k in ("class", "id", "role")).lower())
        hint = next((_HINT_OF[w] for w in words if w in _HINT_OF), "-")
        mark = 1 if "data-main" in given else 0 if "data-off" in given else None
        # what browsers do not show; "until-found" opens when it is searched
        hidden = "hidden" in given and (given["hidden"] or "").lower() != "until-found"
        node = Node(tag, self.stack[-1], hint, mark, unread=hidden or tag in UNREAD)
        depth = len(self.stack)
        self.depths.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.blocks.append(depth)
            if tag in SCOPE:
                self.scopes.append(depth)
        self.nodes.append(node)
        self.stack.append(len(self.nodes) - 1)
        self.unread += node.unread

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # a stray end closes nothing, and one of inline text no block
        if self._open(tag) and (tag not in INLINE or self.depths[tag][-1] > self.blocks[-1]):
            self._pop_to(self.depths[tag][-1])

    def parse_marked_section(self, i, report=1):
        """``<![...`` is a comment up to the next ``>``, as in browsers; only in svg
        and math does CDATA hold text."""
        if self.rawdata.startswith("<![CDATA[", i) and self._open("svg", "math"):
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                self.handle_data(self.rawdata[i + 9:end])
                return end + 3
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if self.unread or not data:
            return
        if self.block is None:
            if data.isspace():
                return
            self.nodes.append(Node("#text", self.stack[self.blocks[-1]]))
            self.block = len(self.nodes) - 1
        node = self.nodes[self.block]
        node.text.append(data)
        if self._open("a"):
            node.linked += len(data)


def parse(html: str | None) -> list[Node]:
    """Nodes in page order; a parent stands before its children."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def block_text(node: Node) -> str:
    return " ".join("".join(node.text).split())


def kinds(nodes: list[Node]) -> list[tuple[str, str, bool]]:
    """What decides how each node follows its parent's label: tag, announcement, and
    whether most of the text below it is linked, as in menus of any name."""
    size, linked = ([0] * len(nodes) for _ in range(2))
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k].tag == "#text":
            size[k], linked[k] = sum(map(len, nodes[k].text)), nodes[k].linked
        if k:
            size[nodes[k].parent] += size[k]
            linked[nodes[k].parent] += linked[k]
    return [(n.tag if n.tag != "#text" else f"#text in {nodes[n.parent].tag}", n.hint, 2 * linked[k] > size[k])
            for k, n in enumerate(nodes)]


def evidence(node: Node) -> list[tuple[str, int]]:
    """What a text block shows: length, link share, how it ends, a notice of rights."""
    text = block_text(node)
    link = 0 if not node.linked else 1 if 2 * node.linked < len(text) else 2
    return [("size", sum(len(text) > x for x in (25, 80, 240))), ("link", link),
            ("stop", int(text.endswith((".", "!", "?", "…")))),
            ("rights", int(len(text) <= 240 and bool(_RIGHTS.search(text))))]


@dataclass
class Model:
    """Parent-child potentials as log odds of a content child under a content
    parent (``base`` plus the parts of ``tag``, ``hint`` and ``menu``, mostly linked
    text) and under another parent (``orphan``), the log odds of the ``root``, and the log
    likelihood of what text blocks show, by label, with its ``weight``: blocks of a
    page are alike, so what each shows counts for less than one."""

    base: float
    tag: dict
    hint: dict
    menu: float
    orphan: float
    root: float
    shown: dict
    weight: float = 0.25

    def edge(self, kind: tuple[str, str, bool]) -> tuple[tuple[float, float], tuple[float, float]]:
        tag, hint, menu = kind
        odds = self.base + self.tag.get(tag, 0.0) + self.hint.get(hint, 0.0) + self.menu * menu
        return _both(self.orphan), _both(odds)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of being content for each node, by two passes of messages."""
        n = len(nodes)
        up = [[0.0, 0.0] for _ in range(n)]  # evidence of the subtree
        for k, node in enumerate(nodes):
            if node.tag == "#text":
                for f in evidence(node):
                    x = self.shown.get(f, (0.0, 0.0))
                    up[k][0] += self.weight * x[0]
                    up[k][1] += self.weight * x[1]
        sent, edges = [(0.0, 0.0)] * n, [self.edge(x) for x in kinds(nodes)]
        for k in range(n - 1, 0, -1):
            e = edges[k]
            sent[k] = tuple(_log_add(e[y][0] + up[k][0], e[y][1] + up[k][1]) for y in (0, 1))
            top = up[nodes[k].parent]
            top[0] += sent[k][0]
            top[1] += sent[k][1]
        down, out = [_both(self.root)] * n, [0.0] * n
        for k in range(n):
            if k:
                p, e = nodes[k].parent, edges[k]
                rest = [down[p][y] + up[p][y] - sent[k][y] for y in (0, 1)]
                a, b = (_log_add(rest[0] + e[0][y], rest[1] + e[1][y]) for y in (0, 1))
                top = max(a, b)
                down[k] = (a - top, b - top)
            d = (down[k][0] + up[k][0]) - (down[k][1] + up[k][1])
            out[k] = 1.0 / (1.0 + math.exp(min(700.0, d)))
        return out


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def _both(odds: float) -> tuple[float, float]:
    """Log probabilities of the labels 0 and 1."""
    return -_log_add(0.0, odds), -_log_add(0.0, -odds)


def labels_of(nodes: list[Node]) -> list[int]:
    """Given labels of a labelled page: a block inherits the nearest mark; an
    element is content when it holds a content block."""
    inherited, out = [0] * len(nodes), [0] * len(nodes)
    for k, node in enumerate(nodes):
        inherited[k] = node.mark if node.mark is not None else inherited[node.parent] if k else 0
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag == "#text":
            out[k] = inherited[k]
        if out[k]:
            out[nodes[k].parent] = 1
    return out


def train(pages: list[str]) -> Model:
    """Fit the model on labelled pages; the weight of what blocks show is the one
    under which pages left out in turn have the likeliest block labels."""
    read = [(nodes, labels_of(nodes)) for nodes in map(parse, pages)]
    halves = [(_fit(read[k::2]), read[1 - k::2]) for k in (0, 1)]

    def loss(weight: float) -> float:
        total = 0.0
        for model, rest in halves:
            model.weight = weight
            for nodes, y in rest:
                for n, label, p in zip(nodes, y, model.marginals(nodes)):
                    if n.tag == "#text":
                        total -= math.log(max(p if label else 1 - p, 1e-9))
        return total

    model = _fit(read)
    model.weight = min(WEIGHTS, key=loss)
    return model


def _fit(read: list[tuple[list[Node], list[int]]]) -> Model:
    """The edge weights of tags, hints and link share together (logistic regression on
    the children of content nodes); what text blocks show by counting, where a
    block's element was in question; root and orphans by counting."""
    edges, shown, label, orphans, roots = [], Counter(), Counter(), Counter(), Counter()
    for nodes, y in read:
        roots[y[0]] += 1
        of = kinds(nodes)
        for k in range(1, len(nodes)):
            parent = nodes[k].parent
            if y[parent]:
                edges.append((*of[k], y[k]))
            else:
                orphans[y[k]] += 1
            if nodes[k].tag == "#text" and (y[parent] or y[nodes[parent].parent]):
                label[y[k]] += 1
                for f in evidence(nodes[k]):
                    shown[f, y[k]] += 1
    tags = sorted({t for t, _, _, _ in edges})
    hints = sorted({h for _, h, _, _ in edges} - {"-"})
    x = np.zeros((len(edges), 2 + len(tags) + len(hints)))
    x[:, 0] = 1
    for r, (t, h, menu, _) in enumerate(edges):
        x[r, 1 + tags.index(t)] = 1
        if h != "-":
            x[r, 1 + len(tags) + hints.index(h)] = 1
        x[r, -1] = menu
    target, w = np.array([e[-1] for e in edges], float), np.zeros(x.shape[1])
    ridge = 0.05 * np.eye(len(w))
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ w)
    w = w.tolist()

    def odds(counts: Counter) -> float:
        return math.log((counts[1] + 0.5) / (counts[0] + 0.5))

    return Model(w[0], dict(zip(tags, w[1:])), dict(zip(hints, w[1 + len(tags):])), w[-1], odds(orphans), odds(roots),
                 {f: tuple(math.log((shown[f, y] + 1) / (label[y] + 4)) for y in (0, 1))
                  for f in {f for f, _ in shown}})


def main_text(model: Model, html: str | None) -> str:
    nodes = parse(html)
    p = model.marginals(nodes)
    blocks = (block_text(n) for n, q in zip(nodes, p) if n.tag == "#text" and q > 0.5)
    return "\n".join(b for b in blocks if b)


def extract(df: DataFrame, html_col: str = "html", pages: list[str] | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars`` (code points); ``pages`` are labelled pages to
    train on instead of the ones that come with the library."""
    model = train(labelled_pages() if pages is None else pages)

    def make():
        def apply(texts):
            got = [main_text(model, t) for t in texts]
            return [got, [len(g) for g in got]]
        return apply

    return map_texts(df, html_col, "text string, n_chars long", make)
