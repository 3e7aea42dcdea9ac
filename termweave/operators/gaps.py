"""C2/C7 without moving the terms that target and competitors share.

``compare.term_stats`` shuffles every term of every competitor, and only after that
exchange it is known which of them the target has, so can never be a gap.  Here the
target comes to its competitors first:

1. The documents of a set are dealt into buckets by a hash of their id, one bucket for
   each ``docs_per_bucket`` documents, and the target's tokens are copied into each
   bucket of its set.  One exchange, of tokens.
2. Inside a bucket the counts of a run (the longest n-gram at a position, ``terms.runs``)
   and whether the target has it are known without a further exchange.  Runs the target
   has go, and with them all their n-grams, which the target has too; one bucket keeps them,
   to say which shorter n-grams of other runs the target has.
3. What is left is summed over the buckets, n-gram by n-gram: the second exchange, with one
   row for a run and not one for each n.  Shorter n-grams of the target go behind it.

The number of buckets follows the size of the set, so a set with a third of all documents
is spread in proportion, and the copies are at most ``1 / docs_per_bucket`` of the documents
and one for each set.  Both sides read it from a table of ``SLOTS`` numbers (a scalar
subquery); sets that hash to one slot share the larger number, which only costs copies.
Nothing is broadcast by row count and no job runs while the plan is built.

Results are those of ``compare.gap_terms``: a blank target makes every competitor term a
gap, sets without competitors and empty tables give no row, a repeated (set, document)
row counts its terms again, and a document of any length is one row of one bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators import compare as CM
from termweave.operators import terms as TM
from termweave.session import parts

SLOTS = 4_096
DOCS_PER_BUCKET = 256


def _slot() -> F.Column:
    return F.pmod(F.xxhash64("set_id"), F.lit(SLOTS)).cast("int")


def bucket_numbers(docs: DataFrame, docs_per_bucket: int) -> F.Column:
    """Buckets of the sets of each slot, as an array of ``SLOTS`` numbers."""
    size = docs.groupBy("set_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > docs_per_bucket)
    most = size.groupBy(_slot().alias("at")).agg(F.max(F.ceil(F.col("size") / docs_per_bucket)).cast("int").alias("n"))
    found = most.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)),
                                    lambda s: F.coalesce(F.try_element_at("m", s), F.lit(1)))).scalar()


def dealt_tokens(docs: DataFrame, stopwords: Iterable[str] | DataFrame | None,
                 docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """``(set_id, doc_id, role, bucket, tokens)``, hash-partitioned by set and bucket: a
    competitor in one bucket, the target in all of its set."""
    toks = TM.doc_tokens(docs, stopwords, keep=("role",), by_doc=False)
    wide = toks.withColumn("_all", bucket_numbers(docs, docs_per_bucket)).withColumn(
        "_n", F.coalesce(F.element_at("_all", _slot() + 1), F.lit(1))).drop("_all")
    own = F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int")
    places = F.when(F.col("role") == "target", F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(own))
    # explode_outer: see ``terms``; the tokens travel as one string, half the bytes of an array
    dealt = wide.select("set_id", "doc_id", "role", F.array_join("tokens", " ").alias("_line"),
                        F.explode_outer(places).alias("bucket")).repartition(parts(docs), "set_id", "bucket")
    tokens = F.when(F.col("_line") == "", F.array().cast("array<string>")).otherwise(F.split("_line", " "))
    return dealt.select("set_id", "doc_id", "role", tokens.alias("tokens"), "bucket")


def bucket_stats(tokens: DataFrame, ns: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``compare.run_stats`` of whole runs inside each bucket: ``(set_id, bucket, run, frequency,
    in_target, in_competitors, first)``; no exchange after ``dealt_tokens``."""
    found = TM.runs(tokens, ns, keep=("role", "bucket")).withColumn("_place", CM.place(CM._is_comp()))
    return found.groupBy("set_id", "bucket", "run").agg(
        F.count_if(CM._is_comp()).alias("frequency"), F.max(CM._is_target()).alias("in_target"),
        F.max(CM._is_comp()).alias("in_competitors"), F.min("_place").alias("first"))


def gap_stats(tokens: DataFrame, ns: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The rows of ``compare.run_stats`` that are gaps, from ``dealt_tokens``."""
    left = bucket_stats(tokens, ns).filter(~F.col("in_target") | (F.col("bucket") == 0))
    return TM.group_runs(left.drop("bucket", "in_competitors"), ns, [
        F.sum("frequency").alias("frequency"), F.max("in_target").alias("in_target"),
        F.max(F.col("frequency") > 0).alias("in_competitors"), F.min("first").alias("first")]).filter(
        F.col("in_competitors") & ~F.col("in_target"))


def pruned_gap_terms(docs: DataFrame, stopwords: Iterable[str] | DataFrame | None,
                     ns: Sequence[int] = (1, 2, 3), k: int | None = 50,
                     docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """C2 from documents with roles: ``(set_id, n, term, frequency, rank)``."""
    return CM.gap_terms(gap_stats(dealt_tokens(docs, stopwords, docs_per_bucket), ns), k)
