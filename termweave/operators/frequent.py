"""V1 by thresholds: the most frequent terms of every set without moving its rare ones.

``tfidf.vocabulary`` shuffles every distinct term of a set to keep a few hundred.  Here
the texts of a set are dealt into buckets of whole documents, one exchange, and
everything up to the last step works on the counts inside a bucket:

1. Each bucket names its ``k`` most frequent terms.  Their counts, summed over the
   buckets, are lower bounds of the true totals, so the ``k``-th largest sum is a lower
   bound of the total a term needs to be in the cut.
2. A term whose total reaches the bound reaches ``bound / buckets`` in some bucket.  The
   terms that do are the candidates; none of the cut, ties included, can be missing.
3. The candidates are written into a filter of fixed size.  All
   counts of the terms it lets pass are summed, so every total is exact; terms let
   pass by chance only add rows.

Where the bound says nothing (fewer than ``k`` terms, or a bound so low that one
occurrence reaches it) every count of the set passes beside the filter, and the step is
the plain aggregate.  What is moved beside the texts: ``k`` rows of each bucket, and the
counts of the terms that pass.  The tokens are counted twice, the second time behind the
filter; the totals over one of the first time are stored, for thresholds and candidates.

Totals, thresholds and filter are made by three jobs while the plan is built, and stored in
the shared checkpoint folder.  Blank documents and documents without tokens add
to ``n_docs`` as in ``tfidf.vocabulary``; a repeated (set, document) row counts as one
document; null sets, which role assignment removes, would form a set of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import terms as TM
from termweave.operators import tfidf as TF
from termweave.session import by_key, ensure_checkpoint_dir, parts
from termweave.sources.docsets import nonblank

# Thresholds are looked up by a hash of the set; sets that share a slot share the lower one.
SLOTS = 4_096
# Numbers of 64 bits in the candidates' filter (256 KB).
FILTER_WORDS = 1 << 15
# Bytes of a set's texts for one bucket.
BUCKET_BYTES = 4 << 20
KEYS = ("set_id", "n", "term")


def bucket_numbers(docs: DataFrame) -> F.Column:
    """Buckets of the sets of each slot, as an array of ``SLOTS`` numbers: one for each
    ``BUCKET_BYTES`` of a set's texts.  The fewer documents of a set are apart, the nearer a
    bucket's counts are to the totals, and the fewer candidates there are."""
    size = docs.groupBy("set_id").agg(F.sum(F.octet_length("text")).alias("size")).filter(F.col("size") > BUCKET_BYTES)
    most = size.groupBy(_slot("set_id").alias("at")).agg(F.max(F.ceil(F.col("size") / BUCKET_BYTES)).cast("int").alias("n"))
    found = most.agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)),
                                    lambda s: F.coalesce(F.try_element_at("m", s), F.lit(1)))).scalar()


def bucket_rows(docs: DataFrame, min_chars: int, ns: Sequence[int], buckets: int | None = None) -> DataFrame:
    """``(set_id, bucket, doc_id, n, pos, term)`` with the marker rows of ``tfidf``, dealt into
    at most ``buckets`` (default: ``bucket_numbers``) groups of documents of a set.  One
    exchange, of the texts, which are smaller than their tokens."""
    texts = nonblank(docs).select("set_id", "doc_id", "text")
    if buckets:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    else:
        texts = texts.withColumn("_all", bucket_numbers(docs))
        bucket = F.pmod(F.xxhash64("doc_id"), F.coalesce(F.element_at("_all", _slot("set_id") + 1), F.lit(1))).cast("int")
    # a bucket may be as large as a partition: twice as many leave fewer of them together
    dealt = texts.select("set_id", bucket.alias("bucket"), "doc_id", "text").repartition(2 * parts(docs), "set_id", "bucket")
    toks = dealt.select("set_id", "bucket", "doc_id", T.word_tokens(F.col("text"), min_chars).alias("tokens"))
    return TM.grams(toks, ns, ("set_id", "bucket", "doc_id"), TF.MARK)


def bucket_counts(docs: DataFrame, min_chars: int = 1, ns: Sequence[int] = (1,),
                  buckets: int | None = None) -> DataFrame:
    """``(set_id, bucket, n, term, total, df)``: counts inside each bucket."""
    tf = bucket_rows(docs, min_chars, ns, buckets).groupBy("set_id", "bucket", "doc_id", "n", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    return tf.groupBy("set_id", "bucket", "n", "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))


def bucket_totals(docs: DataFrame, min_chars: int = 1, ns: Sequence[int] = (1,),
                  buckets: int | None = None) -> DataFrame:
    """``bucket_counts`` without ``df``, so without counts per document: all that thresholds
    and candidates need."""
    return bucket_rows(docs, min_chars, ns, buckets).groupBy("set_id", "bucket", "n", "term").agg(
        F.count(F.lit(1)).alias("total"))


def stored_totals(totals: DataFrame) -> DataFrame:
    """The totals that thresholds and candidates read, made once: those over one (a
    threshold of one or less lets everything pass) and the marker rows."""
    ensure_checkpoint_dir(totals.sparkSession)
    return totals.filter((F.col("total") > 1) | (F.col("term") == TF.MARK)).checkpoint(eager=True)


def thresholds(counts: DataFrame, k: int) -> DataFrame:
    """``(set_id, n, least)``: every term of the cut has at least ``least`` occurrences in
    some bucket (0 where a set has fewer than ``k`` terms in sight).  A marker row says that a
    bucket has documents of the set, whether or not a term of it is in sight."""
    mark = F.col("term") == TF.MARK
    inside = Window.partitionBy("set_id", "bucket", "n").orderBy(F.desc(mark), F.desc("total"), "term")
    top = counts.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= k + 1)
    low = top.groupBy(*KEYS).agg(F.sum("total").alias("low"), F.count(F.lit(1)).alias("buckets"))
    whole = Window.partitionBy("set_id", "n")
    placed = (low.withColumn("place", F.row_number().over(whole.orderBy(F.desc(mark), F.desc("low"), "term")) - 1)
              .withColumn("terms", F.count_if(~mark).over(whole)).withColumn("parts", F.max(F.when(mark, F.col("buckets"))).over(whole)))
    return placed.filter(~mark & (F.col("place") == F.least(F.lit(k), "terms"))).select(
        "set_id", "n", F.when(F.col("terms") >= k, F.col("low") / F.col("parts")).otherwise(F.lit(0.0)).alias("least"))


def _slot(*cols: str) -> F.Column:
    return F.pmod(F.xxhash64(*(cols or ("set_id", "n"))), F.lit(SLOTS)).cast("int")


def _stored(spark, value: F.Column) -> F.Column:
    """A scalar subquery made once, by a job, and read again from the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.range(1).select(value.alias("value")).checkpoint(eager=True).scalar()


def stored_thresholds(counts: DataFrame, k: int) -> F.Column:
    """The thresholds by slot, as an array of ``SLOTS`` numbers."""
    slots = thresholds(counts, k).groupBy(_slot().alias("at")).agg(F.min("least").alias("least"))
    found = slots.agg(F.map_from_entries(F.collect_list(F.struct("at", "least"))).alias("m"))
    return _stored(counts.sparkSession, found.select(F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0.0)))).scalar())


def candidates(counts: DataFrame, least: F.Column) -> DataFrame:
    """The counts that reach the threshold of their set, where it is over one."""
    own = F.element_at(least, _slot() + 1)
    return counts.filter((F.col("term") != TF.MARK) & (own > 1) & (F.col("total") >= own))


def passing(counts: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """What the last exchange moves: the counts of every term the candidates' filter lets
    pass, all counts of sets whose threshold is one or less, and the marker rows.
    ``totals``: ``stored_totals`` of the same counts, for the thresholds and the filter."""
    totals = counts if totals is None else totals
    word = F.struct(*KEYS)
    least = stored_thresholds(totals, k)
    bits = _stored(counts.sparkSession, TM.word_filter(candidates(totals, least).select(word.alias("word")), FILTER_WORDS))
    at, bit = TM.filter_place(word, FILTER_WORDS)
    return counts.filter((F.col("term") == TF.MARK) | (F.element_at(least, _slot() + 1) <= 1)
                         | (F.getbit(F.element_at(bits, at + 1), bit) == 1))


def frequent_terms(docs: DataFrame, k: int, min_chars: int = 1, ns: Sequence[int] = (1,),
                   buckets: int | None = None) -> DataFrame:
    """The rows of ``tfidf.vocabulary`` for each n: ``(set_id, n, term, total, df, n_docs,
    rank)`` of the ``k`` terms with the largest totals, ties by term."""
    args = (docs, min_chars, ns, buckets)
    kept = passing(bucket_counts(*args), k, stored_totals(bucket_totals(*args)))
    totals = by_key(kept, *KEYS).groupBy(*KEYS).agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    return TF.cut(totals, k, ("set_id", "n"))
