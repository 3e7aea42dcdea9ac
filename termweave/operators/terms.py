"""Terms table and per-document frequency operators.

Plan shape: the token arrays are hash-partitioned once on ``(set_id,
doc_id)`` (``by_document``).  Every per-document step after that (n-gram
explode, term counts, ranks, densities) is grouped on a superset of those
keys, so Spark plans no further exchange for them; partial aggregation runs
before any later set-level shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.session import parts

DOC_KEYS = ("set_id", "doc_id")


def by_document(df: DataFrame) -> DataFrame:
    """Hash-partition on the document key (the one shuffle of per-document data), in as
    many partitions as the n-grams to come need."""
    return df.repartition(parts(df), *DOC_KEYS)


def doc_tokens(docs: DataFrame, stopwords: Iterable[str] | DataFrame | None, min_length: int = 2,
               alphabet: str = T.KEPT_LETTERS, text_col: str = "text",
               keep: Sequence[str] = (), by_doc: bool = True) -> DataFrame:
    """T11 per document: ``(set_id, doc_id, *keep, tokens ARRAY<STRING>)``.

    ``stopwords`` as Python words are a literal set; as a DataFrame (column
    ``word``, any length) see ``drop_table_words``.  ``by_doc=True`` hash-partitions
    the token arrays by document so the per-document operators run
    exchange-free; map-only and set-level operators pass ``False``.
    """
    cols = [*DOC_KEYS, *keep]
    table = stopwords if isinstance(stopwords, DataFrame) else None
    out = docs.select(*cols, T.tokenize(F.col(text_col), None if table is not None else stopwords,
                                        min_length, alphabet).alias("tokens"))
    if table is not None:
        out = drop_table_words(out, table, cols)
    return by_document(out) if by_doc else out


# Numbers of 64 bits in the filter of ``drop_table_words`` (32 KB, whatever the length of
# the table; one of more than some 100,000 words clears little, but loses nothing).
FILTER_WORDS = 1 << 12


def filter_place(word, size: int | None = None) -> tuple[F.Column, F.Column]:
    """Place of a word in the filter: the number, and the bit in it."""
    h = F.xxhash64(word)
    return F.pmod(F.shiftright(h, 6), F.lit(size or FILTER_WORDS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def word_filter(words: DataFrame, size: int | None = None) -> F.Column:
    """One bit for the hash of every word of the table (column ``word``), as an array of
    ``size`` (``FILTER_WORDS``) numbers: a scalar subquery of fixed size."""
    at, bit = filter_place(F.col("word"), size)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    none = words.sparkSession.range(size or FILTER_WORDS).select(
        F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("bit"))
    bits = words.select(at.alias("at"), one.alias("bit")).unionByName(none).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    # in order of place: a map would be searched from its start for every place
    return bits.agg(F.array_sort(F.collect_list(F.struct("at", "bits"))).alias("all")).select(F.col("all.bits")).scalar()


def drop_table_words(tokens: DataFrame, words: DataFrame, cols: Sequence[str]) -> DataFrame:
    """T10 with a table of words (column ``word``, distinct), of any length.

    The tokens are shuffled once, by document, and then filtered inside the row.  A
    filter of fixed size clears most of them; the distinct tokens of a document
    that it does not clear are looked up in the table by a join (a frequent one
    has a row for each document, which adaptive execution splits), and the
    words found come back to their document as a small array.  Documents left
    without tokens keep an empty array."""
    # one key for set and document: nulls in them are values like any other, and the
    # exchange is not taken for one that the rows went through before
    dealt = tokens.withColumn("_key", F.struct(*DOC_KEYS)).repartition("_key")

    def suspect(x: F.Column) -> F.Column:
        at, bit = filter_place(x)
        return F.getbit(F.element_at(F.col("_filter"), at + 1), bit) == 1

    # explode_outer: see ``terms``; a filter on the array would move below the exchange
    asked = dealt.withColumn("_filter", word_filter(words)).select(
        "_key", F.explode_outer(F.array_distinct(F.filter("tokens", suspect))).alias("_word"))
    found = asked.filter(F.col("_word").isNotNull()).join(
        words.select(F.col("word").alias("_word")), "_word", "left_semi")
    gone = found.groupBy("_key").agg(F.collect_set("_word").alias("_gone"))
    kept = F.filter("tokens", lambda x: ~F.array_contains("_gone", x))
    return dealt.join(gone, "_key", "left").select(
        *cols, F.when(F.col("_gone").isNull(), F.col("tokens")).otherwise(kept).alias("tokens"))


def raw_word_tokens(docs: DataFrame, min_chars: int, text_col: str = "text",
                    keep: Sequence[str] = (), by_doc: bool = True) -> DataFrame:
    """T14/T15 per document (TF-IDF token stream, no cleaning / stopwords); ``by_doc`` as in
    ``doc_tokens``."""
    out = docs.select(*DOC_KEYS, *keep, T.word_tokens(F.col(text_col), min_chars).alias("tokens"))
    return by_document(out) if by_doc else out


def terms(tokens: DataFrame, ns: Sequence[int] = (1, 2, 3), keep: Sequence[str] = ()) -> DataFrame:
    """Exploded terms ``(set_id, doc_id, *keep, n, pos, term)``.

    ``pos`` is the start index of the term in the filtered token list.  Which
    ``n`` to build is an argument (a filter on ``n`` would not be pushed below
    the generator).
    """
    return grams(tokens, ns, (*DOC_KEYS, *keep))


def grams(tokens: DataFrame, ns: Sequence[int], cols: Sequence[str], mark: str | None = None) -> DataFrame:
    """``(*cols, n, pos, term)``: the ``T.ngrams`` of ``tokens`` for every n, made from the
    positions of one explode, in compiled code; the arrays of n-grams are never built.
    With ``mark`` each row of ``tokens`` begins with that word, which is in no n-gram but a
    term of its own for every n."""
    ns = [int(n) for n in ns if int(n) >= 1]
    t, pos = F.col("tokens"), F.col("pos")

    def gram(n: int) -> F.Column:
        words = [F.get(t, pos + i) for i in range(n)]
        whole = F.when(pos + n <= F.size(t), words[0] if n == 1 else F.concat_ws(" ", *words))
        return whole if mark is None else F.when(pos == 0, F.lit(mark)).otherwise(whole)

    each = [F.struct(F.lit(n).alias("n"), gram(n).alias("term")) for n in ns]
    none = F.array().cast("array<struct<n:int,term:string>>")
    first = t if mark is None else F.concat(F.array(F.lit(mark)), t)
    # explode_outer: a plain one would push the tokeniser below the exchange
    at = tokens.select(*cols, first.alias("tokens")).select(
        *cols, "tokens", F.posexplode_outer("tokens").alias("pos", "_token")).filter(pos.isNotNull())
    out = at.select(*cols, "pos", F.inline(F.array(*each) if each else none))
    return out.filter(F.col("term").isNotNull()).select(*cols, "n", "pos", "term")


# Partitions that the n-grams beginning with one word are spread over, by their second word.
SPREAD = 8


def runs(tokens: DataFrame, ns: Sequence[int] = (1, 2, 3), keep: Sequence[str] = ()) -> DataFrame:
    """The rows of ``terms`` packed for aggregates over many documents: one for each position,
    ``(set_id, doc_id, *keep, pos, run)``.

    ``run`` is the longest n-gram that begins there, its words joined by one space (as many
    spaces where the document ends before it); the shorter ones are its beginnings
    (``unpacked``).  Tokens hold no space and no null character."""
    longest = max([int(n) for n in ns], default=0)
    words = [F.coalesce(F.get("tokens", F.col("pos") + i), F.lit("")) for i in range(max(longest, 1))]
    # explode_outer: see ``terms``
    at = tokens.select(*DOC_KEYS, *keep, "tokens", F.posexplode_outer("tokens").alias("pos", "_word")).filter(F.col("pos").isNotNull())
    return at.select(*DOC_KEYS, *keep, "pos", F.concat_ws(" ", *words).alias("run"))


def unpacked(packed: DataFrame, ns: Sequence[int], cols: Sequence[str]) -> DataFrame:
    """``(*cols, n, term)``: the n-grams of every ``run``."""
    each = [F.struct(F.lit(int(n)).alias("n"), F.substring_index("run", " ", int(n)).alias("term")) for n in ns]
    none = F.array().cast("array<struct<n:int,term:string>>")
    return packed.select(*cols, F.inline(F.array(*each) if each else none)).filter(~F.col("term").endswith(" "))


def group_runs(packed: DataFrame, ns: Sequence[int], aggs: Sequence[F.Column], **made: F.Column) -> DataFrame:
    """``groupBy("set_id", "n", "term").agg(*aggs)`` over the n-grams of ``runs`` made for the
    same ``ns``; ``made`` are columns for ``aggs``, made once for a run behind the exchange.

    N-grams of more words are hardly shared: their runs move once, in as many partitions as
    the input needs, and all of them are counted behind that exchange.  They are dealt by
    set, first word and one of ``SPREAD`` numbers of the second word, so a single word is
    combined in a few partitions before it moves again, and a word in every document is not
    counted in one task.  Set and words travel as one string, a quarter fewer bytes than as
    columns; sets are not null (roles drop those), and the type says so, for a test of it would
    move below the exchange and make the strings once more."""
    ns = sorted({int(n) for n in ns if int(n) >= 1})
    more, out = [n for n in ns if n > 1], []
    packed = packed.select(*[c for c in packed.columns if c not in ("set_id", "run")],
                           F.concat("run", F.lit("\0"), "set_id").alias("_key"))
    if more:
        key = F.col("_key")
        deal = F.xxhash64(F.substring_index(key, " ", 1), F.pmod(F.xxhash64(F.substring_index(key, " ", 2)), F.lit(SPREAD)),
                          F.substring_index(key, "\0", -1))
        packed = packed.repartition(parts(packed), deal).withColumn("_deal", deal)
    packed = packed.withColumns(made)
    cols = [c for c in packed.columns if c != "_key"]
    if more:
        each = _split_key(packed, "run", cols)
        out.append(unpacked(each, more, (*cols, "set_id")).groupBy("_deal", "set_id", "n", "term").agg(*aggs).drop("_deal"))
    if 1 in ns or not ns:
        word = F.concat(F.substring_index(F.substring_index("_key", "\0", 1), " ", 1), F.substring("_key", *_tail("_key")))
        each = packed.withColumn("_word", word).groupBy("_word").agg(*aggs)
        rest = [c for c in each.columns if c != "_word"]
        one = _split_key(each.withColumnRenamed("_word", "_key"), "term", rest).select("set_id", F.lit(1).alias("n"), "term", *rest)
        out.append(one if ns else one.limit(0))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _tail(key: str) -> tuple[F.Column, F.Column]:
    """Start and length of what follows the words of a key: a null character and the set."""
    return F.char_length(F.substring_index(key, "\0", 1)) + 1, F.lit(1 << 30)


def _split_key(df: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
    """``(*cols, name, set_id)`` from ``_key``."""
    start, size = _tail("_key")
    return df.select(*cols, F.substring_index("_key", "\0", 1).alias(name),
                     F.coalesce(F.substring("_key", start + 1, size), F.lit("")).alias("set_id"))


def term_frequency(tokens: DataFrame, ns: Sequence[int] = (1, 2, 3),
                   keep: Sequence[str] = ()) -> DataFrame:
    """``(set_id, doc_id, *keep, n, term, frequency, first_pos)``."""
    t = terms(tokens, ns, keep)
    return t.groupBy(*DOC_KEYS, *keep, "n", "term").agg(
        F.count(F.lit(1)).alias("frequency"), F.min("pos").cast("int").alias("first_pos"))


def _doc_window(keep: Sequence[str] = ()):
    return Window.partitionBy(*DOC_KEYS, *keep, "n")


def top_terms(tf: DataFrame, k: int | None, keep: Sequence[str] = ()) -> DataFrame:
    """rank terms per (document, n) by frequency desc, first occurrence asc.

    ``rank <= k`` is planned as a (partial) ``WindowGroupLimit``.
    """
    w = _doc_window(keep).orderBy(F.desc("frequency"), F.asc("first_pos"))
    out = tf.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= k) if k is not None else out


def density(tf: DataFrame, k: int | None, keep: Sequence[str] = ()) -> DataFrame:
    """density = frequency / all terms of that n in the document * 100, for
    the top ``k`` terms of F2; the total counts every term, not only the top."""
    total = F.sum("frequency").over(_doc_window(keep))
    out = tf.withColumn("density", F.col("frequency") / total * 100.0)
    return top_terms(out, k, keep)


def token_counts(tokens: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """number of filtered tokens per document."""
    return tokens.select(*DOC_KEYS, *keep, F.size("tokens").cast("bigint").alias("tokens"))


def term_weights(tf: DataFrame, k: int = 100, max_words: int = 100,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Top ``min(k, max_words)`` terms with weight = frequency / max frequency."""
    top = top_terms(tf, min(k, max_words), keep)
    mx = F.max("frequency").over(_doc_window(keep))
    return top.withColumn("weight", F.col("frequency") / mx)
