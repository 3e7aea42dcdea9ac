"""Markup -> node stream, the one Python step (Arrow-batched pandas UDF).

The stdlib ``html.parser`` tokenises; a small tree builder keeps the open
element stack with the rules of a lenient HTML tree:

* no implied end tags: an unclosed ``<p>`` stays open and later ones nest;
* an end tag closes the nearest open element of that name (and everything
  opened after it); with none open it is ignored;
* void elements never open; ``<x/>`` is an empty element;
* ``script``/``style`` bodies are raw text; comments are not text but split
  text nodes; the document closes at its end;
* entities are decoded; an unknown one stays as ``&name`` without its semicolon;
* text under ``rt``, ``rp`` and ``template`` is not text of the elements around it
  (nor of elements inside a template), so it is dropped;
* elements under an excluded tag (and the excluded element itself) are
  dropped with all their text (P2 runs before every other extraction).

Output per page, in document order::

    texts    ARRAY<STRING>   text nodes, each stripped, empty ones dropped
    elements ARRAY<STRUCT<tag, t0, t1, last, attrs>>

``texts[t0:t1]`` are the text nodes inside an element (0-based, end
exclusive), ``elements[i+1 .. last]`` its descendants, and ``attrs`` holds the
attributes (last duplicate wins, no value = '') of the tags listed in
``ATTR_TAGS`` only, to keep the stream lean.  All extraction from this stream
is Spark expressions (``termweave.operators.content``).
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

# Fixed values (must equal the reference's rules):
# - tags whose whole subtree is removed before extraction
EXCLUDED_TAGS = ("nav", "header", "footer", "script", "style", "noscript", "iframe")
# - elements that never have content (lenient HTML tree builder's empty-element list)
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "nextid", "spacer"))

# - elements whose text belongs to themselves only
OWN_TEXT_TAGS = frozenset(("rt", "rp", "template"))

ATTR_TAGS = frozenset(("meta", "img"))

ATTR_T = Ty.ArrayType(Ty.StructType([Ty.StructField("k", Ty.StringType()),
                                     Ty.StructField("v", Ty.StringType())]))
ELEMENT_T = Ty.StructType([
    Ty.StructField("tag", Ty.StringType()),
    Ty.StructField("t0", Ty.IntegerType()),
    Ty.StructField("t1", Ty.IntegerType()),
    Ty.StructField("last", Ty.IntegerType()),
    Ty.StructField("attrs", ATTR_T),
])
NODES_T = Ty.StructType([
    Ty.StructField("elements", Ty.ArrayType(ELEMENT_T)),
    Ty.StructField("texts", Ty.ArrayType(Ty.StringType())),
])


class NodeStream(HTMLParser):
    """Tree builder over ``html.parser`` events producing the node stream."""

    def __init__(self, excluded=EXCLUDED_TAGS, attr_tags=ATTR_TAGS):
        super().__init__(convert_charrefs=False)
        self.excluded = frozenset(excluded)
        self.attr_tags = frozenset(attr_tags)
        self.elements: list[dict] = []
        self.texts: list[str] = []
        self.stack: list[tuple[str, int | None]] = []  # (tag, element index or None if dropped)
        self.depths: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        self.hidden = 0  # open excluded elements
        self.quiet = 0  # open elements that keep their text to themselves
        self.buf: list[str] = []

    # -- text
    def handle_data(self, data):
        self.buf.append(data)

    def handle_charref(self, name):
        self.buf.append(html.unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.buf.append(html5.get(f"{name};", f"&{name}"))

    def flush(self):
        if self.buf:
            s = "".join(self.buf).strip()
            self.buf = []
            if s and not self.hidden and not self.quiet:
                self.texts.append(s)

    # -- structure
    def _open(self, tag, attrs, void):
        self.flush()
        drop = bool(self.hidden) or tag in self.excluded
        idx = None
        if not drop:
            a = None
            if tag in self.attr_tags:
                d = {}
                for k, v in attrs:
                    d[k] = "" if v is None else v
                a = [{"k": k, "v": v} for k, v in d.items()]
            idx = len(self.elements)
            n = len(self.texts)
            self.elements.append({"tag": tag, "t0": n, "t1": n, "last": idx, "attrs": a})
        if void:
            return
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, idx))
        self.quiet += tag in OWN_TEXT_TAGS
        if drop:
            self.hidden += 1

    def _close_top(self):
        tag, idx = self.stack.pop()
        self.depths[tag].pop()
        self.quiet -= tag in OWN_TEXT_TAGS
        if idx is None:
            self.hidden -= 1
        else:
            e = self.elements[idx]
            e["t1"] = len(self.texts)
            e["last"] = len(self.elements) - 1

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, tag in VOID_TAGS)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def handle_endtag(self, tag):
        self.flush()
        if depths := self.depths.get(tag):
            to = depths[-1]
            while len(self.stack) > to:
                self._close_top()

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.buf.append(data[6:])
            self.flush()

    def finish(self):
        self.close()
        self.flush()
        while self.stack:
            self._close_top()
        return {"elements": self.elements, "texts": self.texts}


def parse_nodes(page: str | None) -> dict | None:
    """Node stream of one page (``None`` for a null page)."""
    if page is None:
        return None
    p = NodeStream()
    p.feed(page)
    return p.finish()


@F.pandas_udf(NODES_T)
def _nodes_udf(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    # batches are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch
    for batch in pages:
        rows = [parse_nodes(h) if isinstance(h, str) else None for h in batch]
        yield pd.DataFrame({
            "elements": [r["elements"] if r else None for r in rows],
            "texts": [r["texts"] if r else None for r in rows],
        })


# Marked non-deterministic only so the optimizer never copies the parse into a
# pushed-down filter (it would run twice, and before the data is spread); the
# function itself is deterministic, so recomputation after a lost executor
# gives the same rows.
_nodes_once = _nodes_udf.asNondeterministic()


def nodes(page: Column | str) -> Column:
    """P1 as a column expression: ``STRUCT<elements, texts>`` (see module doc)."""
    from pyspark.sql import SparkSession

    from termweave.session import ship_package

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    return _nodes_once(F.col(page) if isinstance(page, str) else page)
