"""Page-content extraction from the node stream (P2-P11), Spark expressions only.

``nodes`` is the struct produced by ``termweave.functions.markup.nodes`` (the
excluded subtrees are already gone, P2).  The text of an element is its text
nodes joined with ``sep`` (``''``: words around inline tags glue together, as
in the reference).

Lambdas here only reference the node-stream columns themselves, never a
derived array, so no array is recomputed per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import markup
from termweave.functions.text import strip_ws

# Fixed value (must equal the reference's): what the summary shows without an h1.
NO_HEADING = "Aucun"

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _attr(e: Column, key: str) -> Column:
    return F.element_at(F.map_from_entries(e["attrs"]), F.lit(key))


def element_text(texts: Column, e: Column, sep: str = "") -> Column:
    """``get_text(strip=True)`` of element ``e``."""
    return F.array_join(F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]), sep)


def texts_of(nodes: Column, tag: str, sep: str = "") -> Column:
    """All elements with ``tag`` in document order -> their texts."""
    els, texts = nodes["elements"], nodes["texts"]
    return F.transform(F.filter(els, lambda e: e["tag"] == tag),
                       lambda e: element_text(texts, e, sep))


def title(nodes: Column, sep: str = "") -> Column:
    """First title's text, '' if none."""
    return F.coalesce(F.try_element_at(texts_of(nodes, "title", sep), F.lit(1)), F.lit(""))


def meta_description(nodes: Column) -> Column:
    """``content`` of the first meta whose ``name`` is exactly
    'description' (not stripped); '' if absent."""
    metas = F.filter(nodes["elements"],
                     lambda e: (e["tag"] == "meta") & (_attr(e, "name") == "description"))
    first = F.try_element_at(metas, F.lit(1))
    return F.coalesce(_attr(first, "content"), F.lit(""))


def headings(nodes: Column, level: int, sep: str = "") -> Column:
    """P5: texts of every ``h<level>``, empty headings kept as ''."""
    return texts_of(nodes, f"h{level}", sep)


def images_alt(nodes: Column) -> Column:
    """Stripped alt texts of all images, empties dropped."""
    imgs = F.filter(nodes["elements"], lambda e: e["tag"] == "img")
    alts = F.transform(imgs, lambda e: strip_ws(F.coalesce(_attr(e, "alt"), F.lit(""))))
    return F.filter(alts, lambda a: a != "")


def body_text(nodes: Column, sep: str = "", tags=("p", "li")) -> Column:
    """For each p / li under the first body, in document order, its whole
    subtree text; joined with one space.  '' without a body.

    The descendants of the body are the contiguous slice
    ``elements[body + 1 .. last]``, so no element is compared with the body.
    """
    els, texts = nodes["elements"], nodes["texts"]
    idx = F.array_position(F.transform(els, lambda e: e["tag"]), "body").cast("int")  # 1-based, 0 = none
    body = F.try_element_at(els, F.when(idx > 0, idx))
    inside = F.slice(els, idx + 1, body["last"] - idx + 1)
    items = F.filter(inside, lambda e: e["tag"].isin(*tags))
    joined = F.array_join(F.transform(items, lambda e: element_text(texts, e, sep)), " ")
    return F.when(idx > 0, joined).otherwise(F.lit(""))


def all_text(title_c: Column, meta_c: Column, h1: Column, h2: Column, h3: Column,
             body: Column, alts: Column) -> Column:
    """Space-join of the non-empty parts (h4-h6 are not included)."""
    parts = [title_c, meta_c, F.array_join(h1, " "), F.array_join(h2, " "),
             F.array_join(h3, " "), body, F.array_join(alts, " ")]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def page_content(pages: DataFrame, html_col: str = "html", keep=("page_id", "url"),
                 sep: str = "") -> DataFrame:
    """One content row per page.

    ``url, title, meta_description, h1..h6, body_text, images_alt, all_text,
    text_length`` plus ``keep`` columns; rows whose markup is null get null
    content (see ``termweave.sources.pages.fetch_status`` for the error).
    """
    parsed = pages.select(*keep, markup.nodes(F.col(html_col)).alias("nodes"),
                          F.col(html_col).isNull().alias("_null"))
    n = F.col("nodes")
    cols = [title(n, sep).alias("title"), meta_description(n).alias("meta_description")]
    cols += [headings(n, i, sep).alias(f"h{i}") for i in range(1, 7)]
    cols += [body_text(n, sep).alias("body_text"), images_alt(n).alias("images_alt")]
    out = parsed.select(*keep, *cols, "_null")
    at = all_text(*[F.col(c) for c in ("title", "meta_description", "h1", "h2", "h3",
                                        "body_text", "images_alt")])
    out = out.withColumn("all_text", at).withColumn(
        "text_length", F.char_length("all_text").cast("int"))
    content = [c for c in out.columns if c not in (*keep, "_null")]
    return out.select(*keep, *[F.when(~F.col("_null"), F.col(c)).alias(c) for c in content])


def page_summary(content: DataFrame, none_label: str = NO_HEADING, keep=("page_id", "url")) -> DataFrame:
    """P10: title, h1 joined with ', ' (or ``none_label``), description,
    number of h2, text length."""
    h1 = F.when(F.size("h1") > 0, F.array_join("h1", ", ")).otherwise(F.lit(none_label))
    return content.select(*keep, "title", h1.alias("h1"), "meta_description",
                          F.size("h2").alias("h2_count"), "text_length")


def nonempty_content(content: DataFrame) -> DataFrame:
    """P11 (kept side): pages with text to analyse."""
    return content.filter(F.col("all_text") != "")


def empty_content(content: DataFrame) -> DataFrame:
    """P11 (reported side): pages read without any text."""
    return content.filter(F.col("all_text") == "")
