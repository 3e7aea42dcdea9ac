"""End-to-end flows over page tables: single-page report and comparison.

Single page: pages -> content (P1-P9) -> pages with text (P11) -> clean terms
-> top terms / density / term weights per page and n.

Comparison: entries ``(set_id, ord, url)`` (ord 0 = target) -> loaded pages
keyed by URL (S4/S5) -> comparable sets (S6, at least two loaded URLs) ->
documents with roles (D1: a target that failed has text ''; a competitor that
failed is skipped but keeps its number) -> every set operator.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import compare as CM
from termweave.operators import content as CT
from termweave.operators import terms as TM
from termweave.sources import pages as PG
from termweave.sources.docsets import DocSets


def loaded_content(pages: DataFrame, sep: str = "") -> DataFrame:
    """Content rows keyed by URL (duplicates collapse), with ``error``."""
    return PG.content_with_status(PG.dedupe_by_url(pages), sep)


def page_entries(pages: DataFrame) -> DataFrame:
    """Default entries for a page table: set = host, ord by ``page_id``."""
    from termweave.sources.docsets import with_ordinal

    p = pages.select("page_id", "url").withColumn("set_id", PG.host("url"))
    return with_ordinal(p, "set_id", "page_id").select("set_id", "ord", "url")


def comparison_documents(entries: DataFrame, content: DataFrame) -> DocSets:
    """D1 + S6: ``docs (set_id, doc_id, role, ord, url, loaded, text)`` for
    comparable sets.

    ``doc_id`` is the entry number ``ord`` (a URL entered twice is two entries);
    ``loaded`` says whether the page was read, also when it has no text.
    """
    ok = content.filter(F.col("error").isNull()).select("url", "all_text")
    joined = entries.join(ok, "url", "left").withColumn("loaded", F.col("all_text").isNotNull())
    # target: kept even when it failed (text ''); competitors: only when loaded
    docs = joined.filter((F.col("ord") == 0) | F.col("loaded")).select(
        "set_id", F.col("ord").cast("bigint").alias("doc_id"),
        F.when(F.col("ord") == 0, F.lit("target")).otherwise(F.lit("competitor")).alias("role"),
        "ord", "url", "loaded", F.coalesce(F.col("all_text"), F.lit("")).alias("text"))
    seen = entries.join(ok.select("url"), "url", "left_semi").withColumn(
        "error", F.lit(None).cast("string"))
    return DocSets(docs.join(PG.comparable_sets(seen).select("set_id"), "set_id", "left_semi"))


def comparison_metrics(sets: DocSets, stopwords: Iterable[str] | None) -> DataFrame:
    """D3 over page documents: documents = distinct loaded URLs (an empty but
    loaded page counts); words per entry (a URL entered twice counts twice)."""
    toks = TM.doc_tokens(sets.docs, stopwords, keep=("role", "url", "loaded"), by_doc=False)
    return CM.set_metrics(toks.withColumn("_url", F.when(F.col("loaded"), F.col("url"))), "_url")


def comparison_gaps(sets: DocSets, stopwords: Iterable[str] | None, ns=(1, 2, 3),
                    k: int = 50) -> DataFrame:
    """Gap terms per (set, n), top ``k``."""
    toks = TM.doc_tokens(sets.docs, stopwords, keep=("role",))
    return CM.gap_terms(CM.term_stats(TM.terms(toks, ns, keep=("role",))), k)


def distinct_url_docs(sets: DocSets) -> DataFrame:
    """F6/R5 run once per distinct loaded URL (first entry's ord labels it)."""
    d = sets.docs.filter("loaded")
    first = d.groupBy("set_id", "url").agg(F.min("ord").alias("ord"))
    return d.join(first, ["set_id", "url", "ord"], "left_semi").select(
        "set_id", "doc_id", "ord", "url", "text")


def single_page_report(pages: DataFrame, stopwords: Iterable[str] | None, ns=(1, 2, 3),
                       top_n: int = 30) -> DataFrame:
    """3.1: top terms per page and n for pages with text (``set_id`` = url)."""
    content = CT.nonempty_content(PG.content_with_status(pages).filter(F.col("error").isNull()))
    docs = content.select(F.col("url").alias("set_id"), F.col("page_id").alias("doc_id"),
                          F.col("all_text").alias("text"))
    tf = TM.term_frequency(TM.doc_tokens(docs, stopwords), ns)
    return TM.density(tf, top_n)
