"""Set comparison: gaps, common terms, coverage, set metrics, labels
(C1-C7, D2-D4).

Everything hangs on one set-level aggregate, grouped on ``(set_id, n, term)``:
competitor frequency, whether the target has the term, and the first occurrence
among competitors.  ``run_stats`` makes it from terms packed by position
(``terms.runs``), ``term_stats`` from exploded ones; gaps and coverage are read
off it without an anti join.

Order of first occurrence in the competitor bag is ``(ord, pos)``; ``ord``
grows with ``doc_id`` inside a set, so ``(doc_id, first_pos)`` is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators import terms as TM
from termweave.session import by_key
from termweave.sources.docsets import DocSets

# More than a document has positions.
PLACES = 1 << 31


def _is_comp() -> F.Column:
    return F.col("role") == "competitor"


def _is_target() -> F.Column:
    return F.col("role") == "target"


def competitor_bag(terms: DataFrame) -> DataFrame:
    """The competitors' terms, concatenated in input order (no copy: a
    filter; order key ``(doc_id, pos)``)."""
    return terms.filter(_is_comp())


def set_term_stats(tf: DataFrame, by: Sequence[str] = ("set_id", "n", "term")) -> DataFrame:
    """C3 per term: ``(*by, frequency, in_target, in_competitors, first_doc,
    first_pos)`` from per-document counts with a ``role`` column.

    First occurrence among competitors is the smallest ``(doc_id, first_pos)``:
    ``min(doc_id)`` and ``min_by(first_pos, doc_id)`` (one row per document,
    so the pick is exact).  All buffers are fixed-width, so Spark keeps a hash
    aggregate with partial combination (a struct ``min`` would fall back to a
    sort-based aggregate over every row).
    """
    comp_doc = F.when(_is_comp(), F.col("doc_id"))
    return tf.groupBy(*by).agg(
        F.sum(F.when(_is_comp(), F.col("frequency")).otherwise(F.lit(0))).cast("bigint").alias("frequency"),
        F.max(_is_target()).alias("in_target"),
        F.max(_is_comp()).alias("in_competitors"),
        F.min(comp_doc).alias("first_doc"),
        F.min_by(F.when(_is_comp(), F.col("first_pos")), comp_doc).alias("first_pos"))


def term_stats(terms: DataFrame) -> DataFrame:
    """``set_term_stats`` from the exploded terms table (per-document counts
    first; with document-partitioned tokens that step needs no exchange)."""
    keys = [c for c in ("set_id", "doc_id", "role", "n", "term") if c in terms.columns]
    tf = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("frequency"),
                                  F.min("pos").cast("int").alias("first_pos"))
    return set_term_stats(by_key(tf, "set_id", "n", "term"))


def place(comp: F.Column) -> F.Column:
    """``(doc_id, pos)`` of a competitor's row as one number in the same order."""
    return F.when(comp, F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES) + F.col("pos")).cast("decimal(31,0)")


def run_stats(packed: DataFrame, ns: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``term_stats`` from ``terms.runs`` with a ``role``, without counts per document:
    ``(set_id, n, term, frequency, in_target, in_competitors, first)``.

    ``first`` stands for ``(first_doc, first_pos)``: ``doc_id * PLACES + pos`` as one number, whose
    minimum over all occurrences keeps a hash aggregate (null where ``first_doc`` is)."""
    comp = F.col("_comp")
    return TM.group_runs(packed.withColumn("_comp", _is_comp()).drop("role"), ns, [
        F.count_if(comp).alias("frequency"), F.max(~comp).alias("in_target"), F.max(comp).alias("in_competitors"),
        F.min("_place").alias("first")], _place=place(comp))


def gap_terms(stats: DataFrame, k: int | None = 50) -> DataFrame:
    """Competitor terms the target lacks, by competitor frequency desc,
    ties by first occurrence in the competitor bag; top ``k`` per (set, n).

    ``(set_id, n, term, frequency, rank)``; a blank target makes every
    competitor term a gap."""
    gaps = stats.filter(F.col("in_competitors") & ~F.col("in_target"))
    first = ["first"] if "first" in stats.columns else ["first_doc", "first_pos"]
    w = Window.partitionBy("set_id", "n").orderBy(F.desc("frequency"), *first)
    out = gaps.withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out.select("set_id", "n", "term", "frequency", "rank")


def comparison_summary(stats: DataFrame, sets: DocSets | None = None,
                       ns: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``(set_id, n, common_terms_count, coverage_percentage,
    total_competitor_unique_terms, total_target_terms)``.

    Coverage = common / distinct competitor terms * 100, 0 without competitor
    terms.  With ``sets`` every (set, n) gets a row, zeros included.
    """
    agg = stats.groupBy("set_id", "n").agg(
        F.count_if(F.col("in_target") & F.col("in_competitors")).alias("common_terms_count"),
        F.count_if(F.col("in_competitors")).alias("total_competitor_unique_terms"),
        F.count_if(F.col("in_target")).alias("total_target_terms"))
    if sets is not None:
        grid = (sets.docs.select("set_id").distinct()
                .select("set_id", F.explode(F.array(*[F.lit(int(n)) for n in ns])).alias("n")))
        agg = grid.join(agg, ["set_id", "n"], "left").na.fill(
            0, ["common_terms_count", "total_competitor_unique_terms", "total_target_terms"])
    comp = F.col("total_competitor_unique_terms")
    cov = F.when(comp > 0, F.col("common_terms_count") * 100.0 / comp).otherwise(F.lit(0.0))
    return agg.select("set_id", "n", "common_terms_count", cov.alias("coverage_percentage"),
                      "total_competitor_unique_terms", "total_target_terms")


def set_metrics(tokens: DataFrame, url_col: str | None = None) -> DataFrame:
    """D3: ``(set_id, documents, target_words, competitor_words)``.

    ``tokens`` has ``set_id, doc_id, role, tokens`` (one row per input entry:
    a duplicate competitor entry counts twice in the words).  ``documents``
    counts distinct loaded documents (``url_col`` when given)."""
    size = F.size("tokens").cast("bigint")
    return tokens.groupBy("set_id").agg(
        F.countDistinct(url_col or "doc_id").alias("documents"),
        F.coalesce(F.sum(F.when(_is_target(), size)), F.lit(0)).cast("bigint").alias("target_words"),
        F.coalesce(F.sum(F.when(_is_comp(), size)), F.lit(0)).cast("bigint").alias("competitor_words"))


def default_names(ordered: DataFrame, target_name: str = "Target",
                  prefix: str = "Competitor ") -> DataFrame:
    """name = ``target_name`` for ord 0, ``prefix + ord`` for competitors."""
    return ordered.withColumn("name", F.when(F.col("ord") == 0, F.lit(target_name))
                              .otherwise(F.concat(F.lit(prefix), F.col("ord").cast("string"))))


def given_names(ordered: DataFrame, names: DataFrame) -> DataFrame:
    """D2 with names ``(set_id, ord, name)`` given by the caller: documents and
    names are paired by ``ord`` up to the shorter list, and of several documents
    of a set with one name only the last stays."""
    paired = ordered.join(names.select("set_id", "ord", "name"), ["set_id", "ord"])
    last = paired.groupBy("set_id", "name").agg(F.max("ord").alias("ord"))
    return paired.join(last, ["set_id", "name", "ord"], "left_semi")


def comparison_report(stats: DataFrame, ns: Sequence[int] = (1, 2, 3), k: int = 100) -> DataFrame:
    """C6 as one table: the summary of every (set, n) with its ``k`` most frequent
    gap terms, in order, as ``gap_terms ARRAY<STRUCT<term, frequency>>`` (empty
    when there is none).  ``stats`` is read twice; what both parts read of it is the same, so
    the n-grams move once (``first`` and ``frequency`` would be dropped from one part otherwise)."""
    if "first" in stats.columns:
        known = F.col("first").isNull() | (F.col("first") > F.lit(Decimal(-10 ** 30)))  # always true
        stats = stats.withColumn("in_competitors", F.col("in_competitors") & (F.col("frequency") > 0) & known)
    gaps = gap_terms(stats, k).groupBy("set_id", "n").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term", "frequency"))),
        lambda g: F.struct(g["term"].alias("term"), g["frequency"].alias("frequency"))).alias("gap_terms"))
    none = F.array().cast("array<struct<term:string,frequency:bigint>>")
    return comparison_summary(stats, None, ns).join(gaps, ["set_id", "n"], "left").withColumn(
        "gap_terms", F.coalesce("gap_terms", none))


def entry_labels(entries: DataFrame, key: str = "url", target_label: str = "target",
                 prefix: str = "Competitor ") -> DataFrame:
    """One label per distinct (set, key): the target label when the key is
    the target's, else the number of the first competitor entry with it."""
    first = entries.groupBy("set_id", key).agg(F.min("ord").alias("ord"))
    return first.withColumn("label", F.when(F.col("ord") == 0, F.lit(target_label))
                            .otherwise(F.concat(F.lit(prefix), F.col("ord").cast("string"))))


def coverage_bands(summary: DataFrame, reference: float = 80.0, threshold: float = 90.0) -> DataFrame:
    """Gauge band of the coverage value ([0,50) low, [50,75) mid, [75,100]
    high), delta against the reference and whether the threshold is reached."""
    c = F.col("coverage_percentage")
    band = F.when(c < 50, F.lit("low")).when(c < 75, F.lit("mid")).otherwise(F.lit("high"))
    return summary.withColumn("band", band).withColumn("delta", c - F.lit(reference)) \
        .withColumn("meets_threshold", c >= F.lit(threshold))
