"""TF-IDF operators (V1-V12) in long sparse form.

Chain (order matters): raw lower-cased word tokens -> counts per document ->
vocabulary cut to ``max_features`` terms per set by total count -> document
frequency over the kept terms, ``N`` = non-blank documents of the set ->
``idf = ln((1 + N) / (1 + df)) + 1`` -> ``w = tf * idf`` -> L2-normalised per
document over the kept terms -> zero weights are simply absent rows.

Deviations (deterministic in a shuffle): ties at the vocabulary cut keep the
smaller term (X1); equal scores order by term (X2); an empty vocabulary gives
no rows instead of an error (X4); the single-document table always has three
columns (X5).

Plan shape: token arrays are partitioned by document, so the per-document
counts and the L2 norm run without an exchange.  The counts are not stored: the
vocabulary and the weights each make them, the weights only for the terms that a
filter of the vocabulary lets pass.  The vocabulary is small and is stored when the
plan of the weights is built.  A marker row for every non-blank document goes with the
terms, so ``N``, the document frequencies and the totals come from one aggregate; counts
of single words are combined in each partition before its exchange.  The vocabulary cut
is a partial ``WindowGroupLimit``.

A stored vocabulary within Spark's broadcast threshold joins the counts where they are.
Spark would see its size only after it has moved the counts to the join and back.

A larger one is joined by an exchange.  The hottest ``(set_id, term)`` has a row for
every document of its set, so this join is salted by document frequency: a term gets
one salt for every ``ROWS_PER_TASK`` documents that hold it, other terms none.  Which
terms are hot is known to both sides from a table of ``SALT_SLOTS`` numbers (the most
salts of the terms that hash to a slot), a scalar subquery over the vocabulary: its size
is fixed, and terms that share a slot with a hot one are salted alike on both sides.  Its
two exchanges have as many partitions as the input needs: adaptive execution would
coalesce them by compressed bytes, and the sorts behind them would spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import terms as TM
from termweave.session import broadcast_limit, by_key, ensure_checkpoint_dir, parts
from termweave.sources.docsets import DocSets, nonblank

DOC_KEYS = TM.DOC_KEYS

# The term of the marker row of a non-blank document; no token is empty.
MARK = ""
# Rows of one (set, term) that a task of the weighting join should get at most.
ROWS_PER_TASK = 1_000_000
SALT_SLOTS = 4_096
# Numbers of 64 bits in the vocabulary's filter (256 KB).
FILTER_WORDS = 1 << 15
# Bytes of a row of the vocabulary beside its strings.
ROW_BYTES = 64


def _counts(toks: DataFrame, ns, keep, by: tuple = (), mark: str | None = MARK) -> DataFrame:
    rows = TM.grams(toks, ns, (*DOC_KEYS, *keep), mark)
    return rows.groupBy(*DOC_KEYS, *keep, *by, "term").agg(F.count(F.lit(1)).alias("tf"))


def raw_ngram_counts(docs: DataFrame, min_chars: int, ns=(1, 2, 3), keep=("role",), by_doc: bool = True) -> DataFrame:
    """Counts per (document, n, term) for several n in one pass over the texts:
    ``(set_id, doc_id, *keep, n, term, tf)``, with a marker row for each n."""
    return _counts(TM.raw_word_tokens(nonblank(docs), min_chars, keep=keep, by_doc=by_doc), ns, keep, ("n",))


def raw_term_counts(docs: DataFrame, min_chars: int, ngram_range: tuple[int, int] = (1, 1),
                    keep=("role",), marked: bool = True) -> DataFrame:
    """Counts per (document, term) over the TF-IDF token stream of non-blank
    documents: ``(set_id, doc_id, *keep, term, tf)``; with ``marked`` each document
    has a row of term ``MARK`` too."""
    toks = TM.raw_word_tokens(nonblank(docs), min_chars, keep=keep)
    lo, hi = ngram_range
    return _counts(toks, range(max(lo, 1), hi + 1), keep, mark=MARK if marked else None)


def raw_word_counts(sets: DocSets, min_chars: int) -> DataFrame:
    """The marked counts of single words that a vocabulary is made of: those of
    ``raw_term_counts``, from documents dealt in the order of set and document.  A partition
    then holds documents of few sets, which share their words, so far fewer rows are left
    when the words of its sets are combined before they move."""
    if sets.texts is None:
        return raw_term_counts(sets.docs, min_chars)
    dealt = nonblank(sets.texts).repartitionByRange(parts(sets.texts), *DOC_KEYS)
    toks = dealt.select(*DOC_KEYS, T.word_tokens(F.col("text"), min_chars).alias("tokens"))
    return _counts(toks, (1,), ())


def doc_counts(docs: DataFrame) -> DataFrame:
    """V2's N: non-blank documents per set (blank ones never count)."""
    return nonblank(docs).groupBy("set_id").agg(F.count(F.lit(1)).alias("n_docs"))


def vocabulary(tf: DataFrame, max_features: int | None, by=("set_id",), words: bool = False) -> DataFrame:
    """V1 + V2 from marked counts: ``(*by, term, total, df, n_docs, rank)`` for the
    ``max_features`` terms with the largest total count per ``by`` (the set, or set
    and n).  The marker is ranked before all terms, so the cut keeps its row, whose
    document frequency is ``n_docs`` (V2's N: non-blank documents).  ``words``: the terms
    are single words, which documents share, so they are combined before the exchange
    whatever the size of the input (long n-grams hardly are)."""
    rows = tf if words else by_key(tf, *by, "term")
    totals = rows.groupBy(*by, "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    return cut(totals, max_features, by)


def cut(totals: DataFrame, max_features: int | None, by=("set_id",)) -> DataFrame:
    """The cut of ``vocabulary`` on ``(*by, term, total, df)`` with marker rows."""
    is_mark = F.col("term") == MARK
    w = Window.partitionBy(*by).orderBy(F.desc(is_mark), F.desc("total"), F.asc("term"))
    ranked = totals.withColumn("rank", F.row_number().over(w))
    if max_features:
        ranked = ranked.filter(F.col("rank") <= max_features + 1)
    out = ranked.withColumn("n_docs", F.max(F.when(is_mark, F.col("df"))).over(Window.partitionBy(*by)))
    return out.filter(~is_mark).withColumn("rank", F.col("rank") - 1)


def idf(vocab: DataFrame) -> DataFrame:
    """V3: smoothed idf per kept term (``ln((1+N)/(1+df)) + 1``)."""
    return vocab.withColumn("idf", F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0)


def salt_table(vocab: DataFrame, by, rows_per_task: int) -> F.Column:
    """Salts of each slot as an array of ``SALT_SLOTS`` numbers, as a scalar subquery:
    the largest ``ceil(df / rows_per_task)`` of the terms that hash to the slot."""
    hot = vocab.filter(F.col("df") > rows_per_task).groupBy(_slot(by).alias("_slot")).agg(
        F.max(F.ceil(F.col("df") / rows_per_task)).cast("int").alias("_n"))
    found = hot.agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_n"))).alias("m"))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(SALT_SLOTS - 1)),
                                    lambda k: F.coalesce(F.try_element_at("m", k), F.lit(1)))).scalar()


def _slot(by) -> F.Column:
    return F.pmod(F.xxhash64(*by, "term"), F.lit(SALT_SLOTS)).cast("int")


def weights(tf: DataFrame, idf_table: DataFrame, keep=("role",), by=("set_id",),
            rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """V4 + V5: ``weight = tf * idf`` and the L2-normalised ``tfidf_score``.  A filter of
    fixed size drops nearly all terms outside the vocabulary before they are counted again;
    the join drops the rest."""
    # made once, for its size, the salts, the filter and the join
    ensure_checkpoint_dir(idf_table.sparkSession)
    idf_table = idf_table.checkpoint(eager=True)
    word = F.struct(*by, "term")
    bits = TM.word_filter(idf_table.select(word.alias("word")), FILTER_WORDS)
    at, bit = TM.filter_place(word, FILTER_WORDS)
    known = F.getbit(F.element_at(bits, at + 1), bit) == 1
    counts = tf.filter((F.col("term") != MARK) & known)
    more = [c for c in by if c not in DOC_KEYS]
    if table_bytes(idf_table, by) <= broadcast_limit(idf_table.sparkSession):
        joined = counts.join(F.broadcast(idf_table.select(*by, "term", "idf")), [*by, "term"])
    else:
        # the norms need the rows of a document together again
        joined = _salted_join(counts, idf_table, by, rows_per_task).repartition(parts(tf), *DOC_KEYS)
    w = joined.withColumn("weight", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*DOC_KEYS, *more)))
    return w.withColumn("tfidf_score", F.col("weight") / norm).select(
        *DOC_KEYS, *keep, *more, "term", F.col("tf").alias("frequency"), "weight", "tfidf_score")


def table_bytes(table: DataFrame, by=("set_id",)) -> int:
    """About the bytes of a stored vocabulary in memory, by a job over it."""
    strings = sum((F.octet_length(F.col(c).cast("string")) for c in by), F.octet_length("term"))
    return table.agg(F.sum(F.coalesce(strings, F.lit(0)) + ROW_BYTES)).first()[0] or 0


def _salted_join(counts: DataFrame, idf_table: DataFrame, by, rows_per_task: int) -> DataFrame:
    """The counts with the ``idf`` of their term, by an exchange; the rows of a term are
    dealt by document over its salts (see the module)."""
    # never null: a nullable join key would be tested on every exploded term
    salts = F.coalesce(F.element_at(F.col("_salts"), _slot(by) + 1), F.lit(1))
    table = salt_table(idf_table, by, rows_per_task)
    small = idf_table.select(*by, "term", "idf", table.alias("_salts")).select(
        *by, "term", "idf", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    dealt = counts.withColumn("_salts", table).withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), salts).cast("int"), F.lit(0))).drop("_salts")
    keys = [*by, "term", "_salt"]
    return dealt.repartition(parts(counts), *keys).join(small, keys)


def tfidf(sets: DocSets, min_chars: int = 1, ngram_range: tuple[int, int] = (1, 1),
          max_features: int | None = 200, keep=("role",)) -> DataFrame:
    """Full chain: ``(set_id, doc_id, *keep, term, frequency, weight, tfidf_score)``.

    ``min_chars=1, (1, 1), 200`` is ``analyze_multiple_documents`` (V8);
    ``min_chars=2`` with any range is ``analyze_ngrams`` (V9).
    """
    tf = raw_term_counts(sets.docs, min_chars, ngram_range, keep)
    words = max(ngram_range) <= 1
    counted = raw_word_counts(sets, min_chars) if words else tf
    return weights(tf, idf(vocabulary(counted, max_features, words=words)), keep)


def analyze_multiple_documents(sets: DocSets, max_features: int = 200) -> DataFrame:
    """V8: tokeniser A (``\\b\\w+\\b``), unigrams."""
    return tfidf(sets, 1, (1, 1), max_features)


def analyze_ngrams(sets: DocSets, ngram_range: tuple[int, int], max_features: int = 200) -> DataFrame:
    """V9: tokeniser B, any n-gram range; an empty vocabulary gives no rows."""
    return tfidf(sets, 2, ngram_range, max_features)


def analyze_each_n(sets: DocSets, ns=(1, 2, 3), max_features: int = 200, keep=("role",)) -> DataFrame:
    """V9 for each n by itself (own vocabulary and norm), all n together:
    ``(set_id, doc_id, *keep, n, term, frequency, weight, tfidf_score)``.  The vocabulary is
    made by thresholds (``frequent``), without moving the rare n-grams."""
    from termweave.operators import frequent as FQ

    by = ("set_id", "n")
    # with ``texts`` the documents come dealt by document from their roles
    tf = raw_ngram_counts(sets.docs, 2, ns, keep, by_doc=sets.texts is None)
    if not max_features:
        return weights(tf, idf(vocabulary(tf, max_features, by)), keep, by)
    vocab = FQ.frequent_terms(sets.docs if sets.texts is None else sets.texts, max_features, 2, ns)
    return weights(tf, idf(vocab), keep, by)


def ranked(scores: DataFrame, k: int | None, score_col: str | None = None,
           keys=DOC_KEYS) -> DataFrame:
    """Rank rows per document by score desc, then term; keep ``k``.

    The score column is ``tfidf_score`` when present, else ``score``.
    """
    c = score_col or ("tfidf_score" if "tfidf_score" in scores.columns else "score")
    w = Window.partitionBy(*keys).orderBy(F.desc(c), F.asc("term"))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k is not None else out


def analyze_single_document(docs: DataFrame, max_features: int = 100) -> DataFrame:
    """V7, per document: tokeniser B counts, cut to ``max_features`` terms by
    count (ties: smaller term), ``score = frequency / sum(kept frequencies)``.

    ``(set_id, doc_id, term, frequency, score, rank)``; rank orders by
    frequency desc, then term.  Blank text gives no rows.
    """
    tf = raw_term_counts(docs, 2, (1, 1), keep=(), marked=False)
    w = Window.partitionBy(*DOC_KEYS).orderBy(F.desc("tf"), F.asc("term"))
    kept = tf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_features)
    total = F.sum("tf").over(Window.partitionBy(*DOC_KEYS))
    return kept.select(*DOC_KEYS, "term", F.col("tf").alias("frequency"),
                       (F.col("tf") / total).alias("score"), "rank")


def tfidf_gap(sets: DocSets, max_features: int = 200) -> DataFrame:
    """V10 ``compare_documents``: terms scored in at least one competitor and
    not in the target, with the mean score over the competitors that have it.

    A blank target gives an empty gap for its set; a non-blank target without
    any scored term makes every competitor term a gap.
    ``(set_id, term, avg_tfidf_score, competitors)``.
    """
    tf = raw_term_counts(sets.docs, 1)
    scores = weights(tf, idf(vocabulary(raw_word_counts(sets, 1), max_features, words=True)))
    is_comp = F.col("role") == "competitor"
    per_term = scores.groupBy("set_id", "term").agg(
        F.avg(F.when(is_comp, F.col("tfidf_score"))).alias("avg_tfidf_score"),
        F.count_if(is_comp).alias("competitors"),
        F.max(~is_comp).alias("_in_target"))
    # only keys are moved: blank texts are dropped, and the texts with them, in the scan
    live = nonblank(sets.docs).filter(F.col("role") == "target").select("set_id")
    return (per_term.filter((F.col("competitors") > 0) & ~F.col("_in_target")).drop("_in_target")
            .join(live, "set_id", "left_semi"))
