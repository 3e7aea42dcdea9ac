"""Chart-ready tables (R1-R7).  Figures themselves are not drawn; each
operator returns the rows a chart is built from, in long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC_KEYS = ("set_id", "doc_id")


def rounded(value: F.Column, decimals: int) -> F.Column:
    """Table rounding: scale, round the binary value half to even, scale back (a
    decimal tie such as 1.015 is rarely one in binary)."""
    scale = F.lit(float(10 ** decimals))
    return F.rint(value * scale) / scale


def printed(value: F.Column, decimals: int) -> F.Column:
    """A double as C's ``printf("%.nf")`` shows it: ties are decided on the binary
    value (0.025 is a little more than its name says, so it shows as 0.03).

    The scaled value is one double; where that double is a tie, the exact error of
    the product (by splitting both factors in halves) says on which side of
    it the value lies, and only a value without error rounds half to even.  For
    values below 2 ** 53 / 10 ** decimals in size; beyond, all printed digits but
    the first 15 are up to the JVM."""
    scale = float(10 ** decimals)
    s_hi, s_lo = _halves(scale)
    v = value.cast("double")
    product = v * F.lit(scale)
    c = v * F.lit(SPLIT)
    hi = c - (c - v)
    lo = v - hi
    error = lo * F.lit(s_lo) - (((product - hi * F.lit(s_hi)) - lo * F.lit(s_hi)) - hi * F.lit(s_lo))
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    whole = (F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(product)))
    # the sign of a value that rounds to zero stays, as in C
    return F.format_string(f"%.{decimals}f", F.when((whole == 0) & (v < 0), F.lit(-0.0)).otherwise(whole / F.lit(scale)))


# Splits a double into two halves of 26 bits (Dekker).
SPLIT = float(2 ** 27 + 1)


def _halves(x: float) -> tuple[float, float]:
    c = x * SPLIT
    hi = c - (c - x)
    return hi, x - hi


def bar_table(ranked: DataFrame, value_col: str, keys: Sequence[str] = DOC_KEYS,
              top_n: int = 20, decimals: int = 4) -> DataFrame:
    """The first ``top_n`` rows (by ``rank``), ordered ascending by value
    (``bar_order``; ties in reverse rank order), label rounded to ``decimals``."""
    top = ranked.filter(F.col("rank") <= top_n)
    w = Window.partitionBy(*keys).orderBy(F.asc(value_col), F.desc("rank"))
    return top.withColumn("bar_order", F.row_number().over(w)).withColumn(
        "label", rounded(F.col(value_col).cast("double"), decimals))


def density_bars(density: DataFrame, keys: Sequence[str] = DOC_KEYS, top_n: int = 20) -> DataFrame:
    """Density bars, label = density rounded to 2 decimals plus '%'."""
    out = bar_table(density, "density", keys, top_n, 2)
    return out.withColumn("label", F.concat(F.col("label").cast("string"), F.lit("%")))


def gap_bars(gaps: DataFrame, keys: Sequence[str] = ("set_id", "n"), top_n: int = 20) -> DataFrame:
    """Gap bars; the value is ``avg_tfidf_score`` when present, else
    ``tfidf_score``, else the gap ``frequency`` (what the page shows)."""
    for c in ("avg_tfidf_score", "tfidf_score", "frequency"):
        if c in gaps.columns:
            value = c
            break
    if "rank" not in gaps.columns:
        w = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc("term"))
        gaps = gaps.withColumn("rank", F.row_number().over(w))
    return bar_table(gaps, value, keys, top_n, 4)


def comparison_matrix(scores: DataFrame, top_n: int = 15,
                      value_col: str = "tfidf_score") -> DataFrame:
    """R2 in long form ``(set_id, doc_id, term, term_order, value)``.

    Terms: union of each document's first ``top_n`` terms, cut to ``top_n``
    per set by best score then term (deterministic, X3).  One row per
    (document with rows, chosen term); ``value`` is 0 where the document lacks
    the term.  A document's scores become one row, ranked inside it; the best
    terms and the grid both read the exchange of these rows, so the scores are made
    once.  The chosen terms travel as one array of at most ``top_n`` per set.
    """
    ranked = F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col(value_col).cast("double")).alias("k"), F.col("term")))),
        lambda x: F.struct(x["term"].alias("term"), (-x["k"]).alias("value")))
    # dealt by another key than before, so that the exchange stays and is read twice
    docs = scores.groupBy(*DOC_KEYS).agg(ranked.alias("_scores")).repartition(F.xxhash64(*DOC_KEYS))
    first = docs.select("set_id", F.inline(F.slice("_scores", 1, top_n)))
    best = first.groupBy("set_id", "term").agg(F.max("value").alias("_best"))
    w_set = Window.partitionBy("set_id").orderBy(F.desc("_best"), F.asc("term"))
    chosen = best.withColumn("term_order", F.row_number().over(w_set)).filter(
        F.col("term_order") <= top_n)
    per_set = chosen.groupBy("set_id").agg(
        F.array_sort(F.collect_list(F.struct("term_order", "term"))).alias("_terms"))
    values = F.map_from_entries("_scores")
    grid = docs.join(per_set, "set_id").select(*DOC_KEYS, values.alias("_values"), F.inline("_terms"))
    return grid.select(*DOC_KEYS, "term", "term_order",
                       F.coalesce(F.try_element_at("_values", F.col("term")), F.lit(0.0)).alias("value"))


def metric_labels(metrics: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """One row per (key, metric); floats shown with 2 decimals as ``printf``
    shows them, others as they are."""
    fields = [f for f in metrics.schema.fields if f.name not in keys]
    parts = []
    for f in fields:
        is_float = f.dataType.typeName() in ("double", "float")
        v = F.col(f.name)
        label = printed(v, 2) if is_float else v.cast("string")
        parts.append(F.struct(F.lit(f.name).alias("metric"), label.alias("label")))
    return metrics.select(*keys, F.inline(F.array(*parts)))
