"""Document sets: tables of documents grouped into comparison sets.

A *set* is one target document plus its competitors.  ``docs`` has the
columns ``set_id, doc_id, role, text``; the target is the first document of
its set in input order (smallest ``doc_id`` here, ``ord = 0``).

Scale notes
-----------
* The role comes from a per-set ``min(doc_id)`` joined back on the document key
  ``(set_id, doc_id)``.  That key is unique, so a set holding a third of all
  documents is spread like any other, and the join leaves the documents
  partitioned as the per-document operators need them.
* ``with_ordinal`` numbers the documents of a set exactly (0 = target) from
  counts per slice of the order column, on levels of slices; no window sees more
  than ``2 ** SLICE_BITS`` rows, whatever the ids look like.
* Nothing is counted, collected or broadcast while a plan is built; adaptive
  execution picks broadcast joins from measured bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.text import is_blank
from termweave.session import parts, spread
from termweave.sources.ordinals import SLICE_BITS, counts_before


@dataclass
class DocSets:
    """``docs (set_id, doc_id, role, text)``, one row per document.  ``texts``: the same
    rows without roles, before the exchange that the roles need, where there is one."""

    docs: DataFrame
    texts: DataFrame | None = None


def read_documents(spark, sf_dir: str, set_col: str = "source") -> DataFrame:
    """The driver's ``documents`` table as ``(set_id, doc_id, text)``.

    Only the three columns are read (column pruning reaches the scan)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = df.select(F.col(set_col).cast("string").alias("set_id"),
                   F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(df, "set_id", "doc_id")


def targets(docs: DataFrame) -> DataFrame:
    """One row per set: ``(set_id, target_id)``; partial aggregation first."""
    return docs.groupBy("set_id").agg(F.min("doc_id").alias("target_id"))


def with_roles(docs: DataFrame) -> DocSets:
    """Add ``role`` ('target' | 'competitor').

    ``docs`` needs ``set_id, doc_id``; other columns are passed through.
    """
    first = targets(docs.select("set_id", "doc_id")).select(
        "set_id", F.col("target_id").alias("doc_id"), F.lit("target").alias("_t"))
    # in as many partitions as the terms counted behind the join need
    dealt = docs.repartition(parts(docs), "set_id", "doc_id")
    out = dealt.join(first, ["set_id", "doc_id"], "left").withColumn(
        "role", F.coalesce("_t", F.lit("competitor"))).drop("_t")
    known = F.col("set_id").isNotNull()
    return DocSets(out.filter(known), docs.filter(known))


def nonblank(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop documents whose text is null or whitespace-only."""
    return docs.filter(~is_blank(F.col(text_col)))


def with_ordinal(df: DataFrame, group: str = "set_id", order: str = "doc_id",
                 name: str = "ord") -> DataFrame:
    """Exact 0-based rank of ``order`` (an integer column, unique per group) inside
    ``group``, without gathering a group into one task.

    The order column is cut into slices of ``2 ** SLICE_BITS`` values, so a slice
    of a group never holds more rows than that.  A row's rank is its number inside
    the slice plus the rows of the group in earlier slices, which are themselves
    counted by slices of slices (``counts_before``): ids may be dense or random over
    all 64 bits.  No job runs while the plan is built.
    """
    sliced = df.filter(F.col(group).isNotNull() & F.col(order).isNotNull()).withColumn(
        "_slice", F.shiftright(F.col(order).cast("bigint"), SLICE_BITS))
    counts = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts_before(counts, [group], "_slice", "_rows", "_off", SLICE_BITS, 64 - SLICE_BITS).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order)) - 1
    return (sliced.withColumn("_in", inside).join(before, [group, "_slice"])
            .withColumn(name, (F.col("_in") + F.col("_off")).cast("int")).drop("_slice", "_in", "_off"))
