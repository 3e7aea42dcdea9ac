"""Registered queries: one per operator family of the inventory.

Every query reads the driver's tables in full (whole documents, whole pages)
and returns a DataFrame; ``ORACLE`` holds the equivalent DuckDB SQL.  Doubles
are rounded to 6 decimals on both sides (sums differ in the last bits with
the order of addition); arrays are returned joined as strings.

Documents form comparison sets by ``source``: the first document of a source
(smallest ``doc_id``) is the target, all others are competitors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import compare as CM
from termweave.operators import content as CT
from termweave.operators import frequent as FQ
from termweave.operators import gaps as GP
from termweave.operators import report as RP
from termweave.operators import terms as TM
from termweave.operators import tfidf as TF
from termweave.plans import flows as FL
from termweave.plans import oracle as O
from termweave.sources import docsets as DS
from termweave.sources import pages as PG
from termweave.sources import stopwords as SW
from termweave.sources.stopwords import spark_default

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOP_N = 30  # terms shown per table (UI default)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def stop():
    return spark_default("french")


def doc_sets(spark, sf_dir) -> DS.DocSets:
    """Every document, as comparison sets by source (role tagged)."""
    return DS.with_roles(DS.read_documents(spark, sf_dir))


def docs(spark, sf_dir) -> DataFrame:
    """``(set_id, doc_id, role, text)`` for every document."""
    return doc_sets(spark, sf_dir).docs


def doc_tokens(spark, sf_dir, by_doc=True) -> DataFrame:
    """Clean tokens per document (no roles needed), partitioned by document when
    counts per document follow."""
    return TM.doc_tokens(DS.read_documents(spark, sf_dir), stop(), by_doc=by_doc)


def set_terms(spark, sf_dir, ns=(1, 2, 3)):
    """Role-tagged terms, packed by position for the set aggregates."""
    s = doc_sets(spark, sf_dir)
    toks = TM.doc_tokens(s.docs, stop(), keep=("role",), by_doc=False)
    return s, TM.runs(toks, ns, keep=("role",))


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- T: text

@register("clean_text", O.with_ctes(O.DOCS_CTE) +
          f"select doc_id, {O.clean_sql('text')} as cleaned from docs")
def q_clean_text(spark, sf_dir):
    d = DS.read_documents(spark, sf_dir)
    return d.select("doc_id", T.clean_text("text").alias("cleaned"))


@register("tokens", O.with_ctes(O.DOCS_CTE, O.tokens_cte()) +
          "select doc_id, cast(len(tokens) as bigint) as n_tokens, "
          "array_to_string(tokens, ' ') as tokens from toks")
def q_tokens(spark, sf_dir):
    t = doc_tokens(spark, sf_dir, by_doc=False)
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def _ngrams_query(n):
    sql = (O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((n,))) +
           "select doc_id, n, pos, term from terms")

    def q(spark, sf_dir):
        return TM.terms(doc_tokens(spark, sf_dir, by_doc=False), (n,)).select("doc_id", "n", "pos", "term")
    register(f"ngrams_{n}", sql)(q)


for _n in (1, 2, 3):
    _ngrams_query(_n)


def _word_tokens_query(name, min_chars):
    sql = (O.with_ctes(O.DOCS_CTE) +
           f"select doc_id, cast(len(w) as bigint) as n_tokens, array_to_string(w, ' ') as tokens "
           f"from (select doc_id, {O.words_sql('text', min_chars)} as w from docs)")

    def q(spark, sf_dir):
        d = DS.read_documents(spark, sf_dir)
        w = T.word_tokens("text", min_chars)
        return d.select("doc_id", F.size(w).cast("bigint").alias("n_tokens"),
                        F.array_join(w, " ").alias("tokens"))
    register(name, sql)(q)


_word_tokens_query("word_tokens_a", 1)
_word_tokens_query("word_tokens_b", 2)


@register("ngram_range_tokens", O.with_ctes(O.DOCS_CTE) +
          "select doc_id, cast(len(g) as bigint) as n_terms, array_to_string(g, '|') as terms from "
          "(select doc_id, " +
          " || ".join(O.ngrams_sql("w", n) for n in (1, 2, 3)) +
          " as g from (select doc_id, " + O.words_sql("text", 2) + " as w from docs))")
def q_ngram_range_tokens(spark, sf_dir):
    d = DS.read_documents(spark, sf_dir)
    g = T.ngram_range(T.word_tokens("text", 2), 1, 3)
    return d.select("doc_id", F.size(g).cast("bigint").alias("n_terms"),
                    F.array_join(g, "|").alias("terms"))


# ---------------------------------------------------------------- F: frequency

@register("term_frequency", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE) +
          "select set_id, doc_id, n, term, frequency, first_pos from tf")
def q_term_frequency(spark, sf_dir):
    return TM.term_frequency(doc_tokens(spark, sf_dir)).select(
        "set_id", "doc_id", "n", "term", "frequency", "first_pos")


def _top_terms_query(n):
    sql = (O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((n,)), O.TF_CTE) +
           "select * from (select set_id, doc_id, n, term, frequency, cast(row_number() over "
           "(partition by set_id, doc_id, n order by frequency desc, first_pos) as integer) as rank "
           f"from tf) where rank <= {TOP_N}")

    def q(spark, sf_dir):
        tf = TM.term_frequency(doc_tokens(spark, sf_dir), (n,))
        return TM.top_terms(tf, TOP_N).select("set_id", "doc_id", "n", "term", "frequency", "rank")
    register(f"top_terms_{n}", sql)(q)


for _n in (1, 2, 3):
    _top_terms_query(_n)


@register("top_terms", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE) +
          "select * from (select set_id, doc_id, n, term, frequency, cast(row_number() over "
          "(partition by set_id, doc_id, n order by frequency desc, first_pos) as integer) as rank "
          f"from tf) where rank <= {TOP_N}")
def q_top_terms(spark, sf_dir):
    """All n in one pass over the texts."""
    return TM.top_terms(TM.term_frequency(doc_tokens(spark, sf_dir)), TOP_N).select(
        "set_id", "doc_id", "n", "term", "frequency", "rank")


@register("density", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((1,)), O.TF_CTE) +
          "select set_id, doc_id, term, round(d, 6) as density, round_even(d * 100, 0) / 100 as density_2, rank "
          "from (select set_id, doc_id, term, frequency * 100.0 / sum(frequency) over "
          "(partition by set_id, doc_id) as d, cast(row_number() over (partition by set_id, doc_id "
          f"order by frequency desc, first_pos) as integer) as rank from tf) where rank <= {TOP_N}")
def q_density(spark, sf_dir):
    tf = TM.term_frequency(doc_tokens(spark, sf_dir), (1,))
    d = TM.density(tf, TOP_N)
    return d.select("set_id", "doc_id", "term", r6("density").alias("density"),
                    RP.rounded(F.col("density"), 2).alias("density_2"), "rank")


@register("token_counts", O.with_ctes(O.DOCS_CTE, O.tokens_cte()) +
          "select set_id, doc_id, cast(len(tokens) as bigint) as tokens from toks")
def q_token_counts(spark, sf_dir):
    return TM.token_counts(doc_tokens(spark, sf_dir, by_doc=False)).select("set_id", "doc_id", "tokens")


# ---------------------------------------------------------------- V: TF-IDF

@register("nonblank_docs", O.with_ctes(O.DOCS_CTE) +
          f"select set_id, doc_id from docs where {O.nonblank_sql('text')}")
def q_nonblank_docs(spark, sf_dir):
    return DS.nonblank(DS.read_documents(spark, sf_dir)).select("set_id", "doc_id")


@register("vocabulary", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          "select set_id, term, total, rank from vocab")
def q_vocabulary(spark, sf_dir):
    s = doc_sets(spark, sf_dir)
    v = TF.vocabulary(TF.raw_word_counts(s, 1), 200, words=True)
    return v.select("set_id", "term", F.col("total").cast("bigint").alias("total"),
                    F.col("rank").cast("int").alias("rank"))


_EACH_N = " union all ".join(
    f"select set_id, doc_id, {n} as n, unnest({O.ngrams_sql('w', n)}) as term from words" for n in (1, 2, 3))


@register("vocabulary_by_threshold", O.with_ctes(
    O.DOCS_CTE, f"nb as (select * from docs where {O.nonblank_sql('text')})",
    f"words as (select set_id, doc_id, {O.words_sql('text', 2)} as w from nb)", f"rw as ({_EACH_N})",
    "nd as (select set_id, count(*) as n_docs from nb group by set_id)",
    "tot as (select set_id, n, term, count(*) as total, count(distinct doc_id) as df from rw group by set_id, n, term)",
    "rk as (select *, cast(row_number() over (partition by set_id, n order by total desc, term) as integer) as rank from tot)") +
          "select set_id, n, term, total, df, n_docs, rank from rk join nd using (set_id) where rank <= 200")
def q_vocabulary_by_threshold(spark, sf_dir):
    v = FQ.frequent_terms(doc_sets(spark, sf_dir).texts, 200, 2, (1, 2, 3))
    return v.select("set_id", "n", "term", F.col("total").cast("bigint").alias("total"), "df", "n_docs",
                    F.col("rank").cast("int").alias("rank"))


@register("idf", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          "select vocab.set_id, term, df, n_docs, round(ln((1.0 + n_docs) / (1.0 + df)) + 1.0, 6) as idf "
          "from vocab join ndocs on vocab.set_id = ndocs.set_id")
def q_idf(spark, sf_dir):
    s = doc_sets(spark, sf_dir)
    v = TF.vocabulary(TF.raw_word_counts(s, 1), 200, words=True)
    t = TF.idf(v)
    return t.select("set_id", "term", "df", "n_docs", r6("idf").alias("idf"))


@register("tfidf_weights", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          "select set_id, doc_id, term, frequency, round(weight, 6) as weight, "
          "round(tfidf_score, 6) as tfidf_score from sc")
def q_tfidf_weights(spark, sf_dir):
    t = TF.tfidf(doc_sets(spark, sf_dir), 1, (1, 1), 200)
    return t.select("set_id", "doc_id", "term", "frequency", r6("weight").alias("weight"),
                    r6("tfidf_score").alias("tfidf_score"))


@register("tfidf_multi", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          "select set_id, doc_id, term, round(tfidf_score, 6) as tfidf_score from sc")
def q_tfidf_multi(spark, sf_dir):
    t = TF.analyze_multiple_documents(doc_sets(spark, sf_dir), 200)
    return t.select("set_id", "doc_id", "term", r6("tfidf_score").alias("tfidf_score"))


def _tfidf_ngrams_query(n):
    sql = (O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(2, (n, n), TOP_N)) +
           "select * from (select set_id, doc_id, term, round(tfidf_score, 6) as tfidf_score, "
           "cast(row_number() over (partition by set_id, doc_id order by tfidf_score desc, term) "
           f"as integer) as rank from sc) where rank <= {TOP_N}")

    def q(spark, sf_dir):
        t = TF.analyze_ngrams(doc_sets(spark, sf_dir), (n, n), TOP_N)
        t = TF.ranked(t, TOP_N)
        return t.select("set_id", "doc_id", "term", r6("tfidf_score").alias("tfidf_score"), "rank")
    register(f"tfidf_ngrams_{n}", sql)(q)


for _n in (1, 2, 3):
    _tfidf_ngrams_query(_n)


def _each_n_sql(n):
    top = ("select set_id, doc_id, " + str(n) + " as n, term, round(round(tfidf_score, 9), 6) as tfidf_score, rank from "
           "(select *, cast(row_number() over (partition by set_id, doc_id order by round(tfidf_score, 9) desc, term) "
           f"as integer) as rank from sc) where rank <= {TOP_N}")
    return "select * from (" + O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(2, (n, n), TOP_N)) + top + ")"


@register("tfidf_ngrams", " union all ".join(_each_n_sql(n) for n in (1, 2, 3)))
def q_tfidf_ngrams(spark, sf_dir):
    """V9 and V12 for all n in one pass over the texts."""
    t = TF.analyze_each_n(doc_sets(spark, sf_dir), (1, 2, 3), TOP_N).withColumn(
        "tfidf_score", F.round("tfidf_score", 9))
    return TF.ranked(t, TOP_N, keys=("set_id", "doc_id", "n")).select(
        "set_id", "doc_id", "n", "term", r6("tfidf_score").alias("tfidf_score"), "rank")


@register("score_top_terms", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          "select * from (select set_id, doc_id, term, round(tfidf_score, 6) as tfidf_score, "
          "cast(row_number() over (partition by set_id, doc_id order by tfidf_score desc, term) "
          "as integer) as rank from sc) where rank <= 20")
def q_score_top_terms(spark, sf_dir):
    t = TF.ranked(TF.analyze_multiple_documents(doc_sets(spark, sf_dir), 200), 20)
    return t.select("set_id", "doc_id", "term", r6("tfidf_score").alias("tfidf_score"), "rank")


@register("single_doc_scores", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(2, (1, 1), None)) +
          "select set_id, doc_id, term, frequency, round(frequency * 1.0 / sum(frequency) over "
          "(partition by set_id, doc_id), 6) as score, rank from (select set_id, doc_id, term, "
          "tf as frequency, cast(row_number() over (partition by set_id, doc_id order by tf desc, term) "
          "as integer) as rank from rtf) where rank <= 100")
def q_single_doc_scores(spark, sf_dir):
    t = TF.analyze_single_document(docs(spark, sf_dir), 100)
    return t.select("set_id", "doc_id", "term", "frequency", r6("score").alias("score"), "rank")


@register("tfidf_gap", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          "select c.set_id, c.term, round(avg(c.tfidf_score), 6) as avg_tfidf_score, "
          "count(*) as competitors from sc c "
          "where c.role = 'competitor' and not exists (select 1 from sc t where t.role = 'target' "
          "and t.set_id = c.set_id and t.term = c.term) and exists (select 1 from docs d where "
          "d.role = 'target' and d.set_id = c.set_id and " + O.nonblank_sql("d.text") + ") "
          "group by c.set_id, c.term")
def q_tfidf_gap(spark, sf_dir):
    g = TF.tfidf_gap(doc_sets(spark, sf_dir), 200)
    return g.select("set_id", "term", r6("avg_tfidf_score").alias("avg_tfidf_score"), "competitors")


# ---------------------------------------------------------------- C / D: sets

@register("competitor_bag", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte()) +
          "select set_id, n, count(*) as terms, count(distinct term) as distinct_terms "
          "from terms where role = 'competitor' group by set_id, n")
def q_competitor_bag(spark, sf_dir):
    _, t = set_terms(spark, sf_dir)
    each = TM.group_runs(CM.competitor_bag(t), (1, 2, 3), [F.count(F.lit(1)).alias("terms")])
    return each.groupBy("set_id", "n").agg(
        F.sum("terms").alias("terms"), F.count(F.lit(1)).alias("distinct_terms"))


def _gap_query(n, k=50):
    sql = O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((n,)), O.TF_CTE, O.STATS_CTE) + O.gap_sql(k)

    def q(spark, sf_dir):
        _, t = set_terms(spark, sf_dir, (n,))
        return CM.gap_terms(CM.run_stats(t, (n,)), k)
    register(f"gap_terms_{n}", sql)(q)


for _n in (1, 2, 3):
    _gap_query(_n)


@register("gap_terms", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE, O.STATS_CTE) + O.gap_sql(50))
def q_gap_terms(spark, sf_dir):
    """All n in one pass over the texts."""
    _, t = set_terms(spark, sf_dir)
    return CM.gap_terms(CM.run_stats(t), 50)


@register("gap_terms_pruned", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE, O.STATS_CTE) + O.gap_sql(50))
def q_gap_terms_pruned(spark, sf_dir):
    """The same rows, without moving the terms the target has."""
    return GP.pruned_gap_terms(doc_sets(spark, sf_dir).docs, stop(), (1, 2, 3), 50)


@register("common_terms", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE, O.STATS_CTE) +
          "select set_id, n, term, frequency from stats where in_target and in_comp")
def q_common_terms(spark, sf_dir):
    _, t = set_terms(spark, sf_dir)
    st = CM.run_stats(t)
    return st.filter(F.col("in_target") & F.col("in_competitors")).select("set_id", "n", "term", "frequency")


COVERAGE_SQL = (O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE, O.STATS_CTE) +
                """, summ as (select set_id, n,
  count(*) filter (where in_target and in_comp) as common_terms_count,
  count(*) filter (where in_comp) as total_competitor_unique_terms,
  count(*) filter (where in_target) as total_target_terms from stats group by set_id, n),
grid as (select distinct set_id, ns.n from docs, (values (1), (2), (3)) ns(n)),
cov as (select g.set_id, g.n, coalesce(common_terms_count, 0) as common_terms_count,
  coalesce(total_competitor_unique_terms, 0) as total_competitor_unique_terms,
  coalesce(total_target_terms, 0) as total_target_terms
  from grid g left join summ s on g.set_id = s.set_id and g.n = s.n)
""")


@register("coverage", COVERAGE_SQL +
          "select set_id, n, common_terms_count, round(case when total_competitor_unique_terms > 0 "
          "then common_terms_count * 100.0 / total_competitor_unique_terms else 0 end, 6) "
          "as coverage_percentage, total_competitor_unique_terms, total_target_terms from cov")
def q_coverage(spark, sf_dir):
    s, t = set_terms(spark, sf_dir)
    c = CM.comparison_summary(CM.run_stats(t), s)
    return c.withColumn("coverage_percentage", r6("coverage_percentage"))


@register("set_metrics", O.with_ctes(O.DOCS_CTE, O.tokens_cte()) +
          "select set_id, count(distinct doc_id) as documents, "
          "cast(coalesce(sum(len(tokens)) filter (where role = 'target'), 0) as bigint) as target_words, "
          "cast(coalesce(sum(len(tokens)) filter (where role = 'competitor'), 0) as bigint) as competitor_words "
          "from toks group by set_id")
def q_set_metrics(spark, sf_dir):
    s = doc_sets(spark, sf_dir)
    return CM.set_metrics(TM.doc_tokens(s.docs, stop(), keep=("role",), by_doc=False))


@register("doc_roles", O.with_ctes(O.DOCS_CTE) + "select set_id, doc_id, role, ord from docs")
def q_doc_roles(spark, sf_dir):
    d = docs(spark, sf_dir).select("set_id", "doc_id", "role")
    return DS.with_ordinal(d)


@register("default_names", O.with_ctes(O.DOCS_CTE) +
          "select set_id, doc_id, case when ord = 0 then 'Target' else 'Competitor ' || ord end as name "
          "from docs")
def q_default_names(spark, sf_dir):
    d = DS.read_documents(spark, sf_dir).select("set_id", "doc_id")
    return CM.default_names(DS.with_ordinal(d)).select("set_id", "doc_id", "name")


@register("doc_labels", O.with_ctes(O.DOCS_CTE) +
          "select set_id, doc_id, case when ord = 0 then 'target' else 'Competitor ' || ord end as label "
          "from docs")
def q_doc_labels(spark, sf_dir):
    d = DS.with_ordinal(DS.read_documents(spark, sf_dir).select("set_id", "doc_id"))
    return CM.entry_labels(d, key="doc_id").select("set_id", "doc_id", "label")


# ---------------------------------------------------------------- S / P: pages

def page_entries(spark, sf_dir) -> DataFrame:
    """Pages as comparison entries ``(set_id, ord, page_id, url, html)``:
    set = host, ord by page_id (exact, skew-safe)."""
    p = PG.read_pages(spark, sf_dir).withColumn("set_id", PG.host("url"))
    return DS.with_ordinal(p, "set_id", "page_id")


@register("page_rows", "select page_id, url, cast(length(html) as bigint) as n_chars from pages")
def q_page_rows(spark, sf_dir):
    p = PG.read_pages(spark, sf_dir)
    return p.select("page_id", "url", F.char_length("html").cast("bigint").alias("n_chars"))


@register("valid_pages", O.with_ctes(O.pages_cte()) +
          "select page_id, url, valid, coalesce(starts_with(url, 'http'), false) as http from pg")
def q_valid_pages(spark, sf_dir):
    p = PG.read_pages(spark, sf_dir)
    return p.select("page_id", "url", PG.url_valid("url").alias("valid"),
                    F.coalesce(F.col("url").startswith("http"), F.lit(False)).alias("http"))


@register("input_checks", O.with_ctes(O.pages_cte()) +
          "select set_id, coalesce(bool_or(starts_with(url, 'http')) filter (where ord = 0), false) as target_ok, "
          "count(*) filter (where ord > 0) as competitors, "
          "coalesce(bool_and(starts_with(url, 'http')) filter (where ord > 0), true) as competitors_ok, "
          "coalesce(bool_or(starts_with(url, 'http')) filter (where ord = 0), false) and "
          "count(*) filter (where ord > 0) >= 1 and "
          "coalesce(bool_and(starts_with(url, 'http')) filter (where ord > 0), true) as runnable "
          "from pg group by set_id")
def q_input_checks(spark, sf_dir):
    return PG.input_ok(page_entries(spark, sf_dir))


@register("page_errors", O.with_ctes(O.pages_cte()) + "select page_id, url, error from pg")
def q_page_errors(spark, sf_dir):
    return PG.fetch_status(PG.read_pages(spark, sf_dir)).select("page_id", "url", "error")


@register("page_dedupe", "select url, min(page_id) as page_id, "
          "cast(length(arg_min(html, page_id)) as bigint) as n_chars from pages group by url")
def q_page_dedupe(spark, sf_dir):
    d = PG.dedupe_by_url(PG.read_pages(spark, sf_dir))
    return d.select("url", "page_id", F.char_length("html").cast("bigint").alias("n_chars"))


@register("comparable_sets", O.with_ctes(O.pages_cte()) +
          "select set_id, count(distinct url) as loaded from pg where error is null "
          "group by set_id having count(distinct url) >= 2")
def q_comparable_sets(spark, sf_dir):
    p = PG.fetch_status(PG.read_pages(spark, sf_dir)).withColumn("set_id", PG.host("url"))
    return PG.comparable_sets(p)


@register("stopword_hits", O.with_ctes(O.DOCS_CTE) +
          "select doc_id, cast(len(list_filter(string_split(" + O.clean_sql("text") + ", ' '), "
          "lambda x: length(x) >= 2)) - len(" + O.tokens_sql("text") + ") as bigint) as stopwords_removed "
          "from docs")
def q_stopword_hits(spark, sf_dir):
    d = DS.read_documents(spark, sf_dir)
    cleaned = T.clean_text("text")
    kept_all = F.size(T.tokens_from_clean(cleaned, None))
    kept = F.size(T.tokens_from_clean(cleaned, stop()))
    return d.select("doc_id", (kept_all - kept).cast("bigint").alias("stopwords_removed"))


def _title_h1_sql():
    t = O.strip_sql(O.decode_sql("regexp_extract(kept, '(?s)<title[^>]*>(.*?)</title>', 1)"))
    h1s = ("list_transform(regexp_extract_all(kept, '(?s)<h1[^>]*>(.*?)</h1>', 1), lambda x: " +
           O.strip_sql(O.decode_sql("regexp_replace(x, '<[^>]*>', '', 'g')")) + ")")
    return (O.with_ctes(O.pages_cte()) +
            f"select page_id, url, {t} as title, case when len({h1s}) > 0 then "
            f"array_to_string({h1s}, ', ') else 'Aucun' end as h1, "
            "cast(len(regexp_extract_all(kept, '<h2[ >]', 0)) as integer) as h2_count from pg")


@register("page_title_h1", _title_h1_sql())
def q_page_title_h1(spark, sf_dir):
    c = CT.page_content(PG.read_pages(spark, sf_dir))
    return CT.page_summary(c).select("page_id", "url", "title", "h1", "h2_count")


@register("page_content", O.with_ctes(*O.page_text_ctes()) +
          "select page_id, url, title, '' as meta_description, h1, '' as h2, '' as h3, '' as h4, "
          "'' as h5, '' as h6, body_text, '' as images_alt, all_text, "
          "cast(length(all_text) as integer) as text_length, error from pt")
def q_page_content(spark, sf_dir):
    c = PG.content_with_status(PG.read_pages(spark, sf_dir))
    return c.select("page_id", "url", "title", "meta_description",
                    *[F.array_join(f"h{i}", "|").alias(f"h{i}") for i in range(1, 7)],
                    "body_text", F.array_join("images_alt", "|").alias("images_alt"),
                    "all_text", "text_length", "error")


# A block put behind each page's first ``</h1>``, by page number, so that the parts
# which the given pages lack (description, h2 to h6, list items, alt texts) vary.
VARIANT_BLOCK = ("<h2>Part {id} &amp; more</h2><h3> a{id} </h3><h3></h3><h4>deep <b>{id}</b></h4><h5>x</h5><h6>y{id}</h6>"
                 "<ul><li>item {id}</li><li><p>in {id}</p></li></ul><img alt=\" pic {id} \"><img alt=\"\"><img src=\"z\">")
VARIANT_META = "<meta name=\"Description\" content=\"no\"><meta name=\"description\" content=\" about {id} \"><title>"


def variant_pages(pages: DataFrame) -> DataFrame:
    """The given pages with ``VARIANT_META`` before the title and, on two pages of three,
    ``VARIANT_BLOCK`` behind the first heading (input of ``page_variants`` only)."""
    number = F.col("page_id").cast("string")
    block = F.when(F.col("page_id") % 3 != 0, F.replace(F.lit(VARIANT_BLOCK), F.lit("{id}"), number)).otherwise(F.lit(""))
    meta = F.replace(F.lit(VARIANT_META), F.lit("{id}"), number)
    at = F.instr("html", "</h1>") + 4
    html = F.when(at > 4, F.concat(F.substring("html", F.lit(1), at), block, F.substring("html", at + 1, F.length("html")))
                  ).otherwise(F.col("html"))
    return pages.withColumn("html", F.replace(html, F.lit("<title>"), meta))


def _variants_sql():
    has = "page_id % 3 <> 0"
    part = lambda x: f"case when {has} then {x} else '' end"
    body = ("case when " + has + " then concat_ws(' ', 'item ' || page_id, 'in ' || page_id, 'in ' || page_id) || "
            "case when bodied then ' ' || body_text else '' end else body_text end")
    return (O.with_ctes(*O.page_text_ctes()) +
            ", v as (select pt.*, exists (select 1 from bd where bd.page_id = pt.page_id) as bodied from pt), "
            "w as (select page_id, url, title, ' about ' || page_id || ' ' as meta_description, h1, " +
            part("'Part ' || page_id || ' & more'") + " as h2, " + part("'a' || page_id || '|'") + " as h3, " +
            part("'deep' || page_id") + " as h4, " + part("'x'") + " as h5, " + part("'y' || page_id") + " as h6, " +
            body + " as body_text, " + part("'pic ' || page_id") + " as images_alt from v) "
            "select *, concat_ws(' ', nullif(title, ''), nullif(meta_description, ''), nullif(h1, ''), nullif(h2, ''), "
            "nullif(replace(h3, '|', ' '), ''), nullif(body_text, ''), nullif(images_alt, '')) as all_text from w")


@register("page_variants", _variants_sql())
def q_page_variants(spark, sf_dir):
    """P3-P8 on pages that have a description, all headings, list items and images."""
    c = CT.page_content(variant_pages(PG.read_pages(spark, sf_dir)))
    return c.select("page_id", "url", "title", "meta_description",
                    *[F.array_join(f"h{i}", "|").alias(f"h{i}") for i in range(1, 7)],
                    "body_text", F.array_join("images_alt", "|").alias("images_alt"), "all_text")


@register("empty_pages", O.with_ctes(*O.page_text_ctes()) +
          "select page_id, url, error, all_text = '' as empty from pt")
def q_empty_pages(spark, sf_dir):
    c = PG.content_with_status(PG.read_pages(spark, sf_dir))
    sides = [f(c).withColumn("empty", F.lit(e)) for f, e in ((CT.empty_content, True), (CT.nonempty_content, False))]
    return sides[0].unionByName(sides[1]).select("page_id", "url", "error", "empty")


# ---------------------------------------------------------------- R: chart tables

_TOP_UNI = (O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((1,)), O.TF_CTE) +
            ", top as (select set_id, doc_id, term, frequency, cast(row_number() over (partition by "
            "set_id, doc_id order by frequency desc, first_pos) as integer) as rank from tf), "
            "dens as (select set_id, doc_id, term, frequency * 100.0 / sum(frequency) over "
            "(partition by set_id, doc_id) as density, cast(row_number() over (partition by set_id, "
            "doc_id order by frequency desc, first_pos) as integer) as rank from tf)\n")


@register("bar_table", _TOP_UNI +
          "select set_id, doc_id, term, frequency, rank, cast(row_number() over (partition by set_id, "
          "doc_id order by frequency, rank desc) as integer) as bar_order, "
          "round_even(cast(frequency as double), 4) as label from top where rank <= 20")
def q_bar_table(spark, sf_dir):
    tf = TM.term_frequency(doc_tokens(spark, sf_dir), (1,))
    b = RP.bar_table(TM.top_terms(tf, 20), "frequency")
    return b.select("set_id", "doc_id", "term", "frequency", "rank", "bar_order", "label")


@register("density_bars", _TOP_UNI +
          "select set_id, doc_id, term, round(density, 6) as density, rank, cast(row_number() over "
          "(partition by set_id, doc_id order by density, rank desc) as integer) as bar_order, "
          "cast(round_even(density * 100, 0) / 100 as varchar) || '%' as label from dens where rank <= 20")
def q_density_bars(spark, sf_dir):
    tf = TM.term_frequency(doc_tokens(spark, sf_dir), (1,))
    b = RP.density_bars(TM.density(tf, 20))
    return b.select("set_id", "doc_id", "term", r6("density").alias("density"), "rank",
                    "bar_order", "label")


@register("gap_bars", O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((1,)), O.TF_CTE, O.STATS_CTE) +
          "select set_id, n, term, frequency, rank, cast(row_number() over (partition by set_id, n "
          "order by frequency, rank desc) as integer) as bar_order, "
          "round_even(cast(frequency as double), 4) as label from (" + O.gap_sql(50) + ") where rank <= 20")
def q_gap_bars(spark, sf_dir):
    _, t = set_terms(spark, sf_dir, (1,))
    b = RP.gap_bars(CM.gap_terms(CM.run_stats(t, (1,)), 50))
    return b.select("set_id", "n", "term", "frequency", "rank", "bar_order", "label")


@register("term_weights", _TOP_UNI +
          "select set_id, doc_id, term, frequency, rank, round(frequency * 1.0 / max(frequency) over "
          "(partition by set_id, doc_id), 6) as weight from top where rank <= 100")
def q_term_weights(spark, sf_dir):
    tf = TM.term_frequency(doc_tokens(spark, sf_dir), (1,))
    w = TM.term_weights(tf, 100, 100)
    return w.select("set_id", "doc_id", "term", "frequency", "rank", r6("weight").alias("weight"))


@register("comparison_matrix", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(2, (1, 1), TOP_N)) +
          """, top as (select * from (select set_id, doc_id, term, tfidf_score, row_number() over
  (partition by set_id, doc_id order by tfidf_score desc, term) as r from sc) where r <= 15),
chosen as (select * from (select set_id, term, cast(row_number() over (partition by set_id
  order by max(tfidf_score) desc, term) as integer) as term_order from top group by set_id, term)
  where term_order <= 15),
dws as (select distinct set_id, doc_id from sc)
select dws.set_id, dws.doc_id, chosen.term, chosen.term_order,
  round(coalesce(sc.tfidf_score, 0.0), 6) as value
from dws join chosen on dws.set_id = chosen.set_id
left join sc on sc.set_id = dws.set_id and sc.doc_id = dws.doc_id and sc.term = chosen.term""")
def q_comparison_matrix(spark, sf_dir):
    s = doc_sets(spark, sf_dir)
    m = RP.comparison_matrix(TF.analyze_ngrams(s, (1, 1), TOP_N), 15)
    return m.withColumn("value", r6("value"))


@register("coverage_bands", COVERAGE_SQL +
          ", cv as (select set_id, n, case when total_competitor_unique_terms > 0 then "
          "common_terms_count * 100.0 / total_competitor_unique_terms else 0 end as c from cov) "
          "select set_id, n, round(c, 6) as coverage_percentage, case when c < 50 then 'low' when c < 75 "
          "then 'mid' else 'high' end as band, round(c - 80, 6) as delta, c >= 90 as meets_threshold from cv")
def q_coverage_bands(spark, sf_dir):
    s, t = set_terms(spark, sf_dir)
    b = CM.coverage_bands(CM.comparison_summary(CM.run_stats(t), s))
    return b.select("set_id", "n", r6("coverage_percentage").alias("coverage_percentage"), "band",
                    r6("delta").alias("delta"), "meets_threshold")


@register("metric_labels", COVERAGE_SQL +
          """, m as (select set_id, count(distinct doc_id) as documents,
  cast(coalesce(sum(len(tokens)) filter (where role = 'target'), 0) as bigint) as target_words,
  cast(coalesce(sum(len(tokens)) filter (where role = 'competitor'), 0) as bigint) as competitor_words
  from toks group by set_id),
c1 as (select set_id, case when total_competitor_unique_terms > 0 then
  common_terms_count * 100.0 / total_competitor_unique_terms else 0 end as c from cov where n = 1)
select set_id, metric, label from (
  select m.set_id, 'documents' as metric, cast(documents as varchar) as label from m
  union all select set_id, 'target_words', cast(target_words as varchar) from m
  union all select set_id, 'competitor_words', cast(competitor_words as varchar) from m
  union all select set_id, 'coverage_percentage', printf('%.2f', c) from c1)""")
def q_metric_labels(spark, sf_dir):
    s = doc_sets(spark, sf_dir)
    toks = TM.doc_tokens(s.docs, stop(), keep=("role",), by_doc=False)
    metrics = CM.set_metrics(toks)
    t = TM.terms(toks, (1,), keep=("role",))
    cov = CM.comparison_summary(CM.term_stats(t), s, (1,)).select("set_id", "coverage_percentage")
    return RP.metric_labels(metrics.join(cov, "set_id"))


# ---------------------------------------------------------------- page flows

def _page_sets(spark, sf_dir):
    pages = PG.read_pages(spark, sf_dir)
    return FL.comparison_documents(FL.page_entries(pages), FL.loaded_content(pages))


def _page_sql(docs_cte, *ctes):
    return O.with_ctes(*O.page_text_ctes(), docs_cte, *ctes)


@register("page_top_terms", _page_sql(O.PAGE_DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE) +
          "select set_id, doc_id, n, term, frequency, round(d, 6) as density, rank from (select *, "
          "frequency * 100.0 / sum(frequency) over (partition by set_id, doc_id, n) as d, "
          "cast(row_number() over (partition by set_id, doc_id, n order by frequency desc, first_pos) "
          f"as integer) as rank from tf) where rank <= {TOP_N}")
def q_page_top_terms(spark, sf_dir):
    r = FL.single_page_report(PG.read_pages(spark, sf_dir), stop(), (1, 2, 3), TOP_N)
    return r.select("set_id", "doc_id", "n", "term", "frequency", r6("density").alias("density"), "rank")


@register("page_set_metrics", _page_sql(O.HOST_DOCS_CTE, O.tokens_cte()) +
          ", loaded as (select set_id, count(distinct url) as documents from pt where error is null group by set_id) "
          "select toks.set_id, documents, "
          "cast(coalesce(sum(len(tokens)) filter (where role = 'target'), 0) as bigint) as target_words, "
          "cast(coalesce(sum(len(tokens)) filter (where role = 'competitor'), 0) as bigint) as competitor_words "
          "from toks join loaded on toks.set_id = loaded.set_id group by toks.set_id, documents")
def q_page_set_metrics(spark, sf_dir):
    return FL.comparison_metrics(_page_sets(spark, sf_dir), stop())


@register("page_gap_terms", _page_sql(O.HOST_DOCS_CTE, O.tokens_cte(), O.terms_cte(), O.TF_CTE, O.STATS_CTE) +
          O.gap_sql(50))
def q_page_gap_terms(spark, sf_dir):
    return FL.comparison_gaps(_page_sets(spark, sf_dir), stop(), (1, 2, 3), 50)


@register("page_densities", _page_sql(O.HOST_DOCS_CTE, O.tokens_cte(), O.terms_cte((1,)), O.TF_CTE) +
          "select set_id, doc_id, term, round(d, 6) as density, rank from (select *, "
          "frequency * 100.0 / sum(frequency) over (partition by set_id, doc_id) as d, "
          "cast(row_number() over (partition by set_id, doc_id order by frequency desc, first_pos) "
          f"as integer) as rank from tf) where rank <= {TOP_N}")
def q_page_densities(spark, sf_dir):
    """one density table for each distinct URL of a set."""
    docs_ = FL.distinct_url_docs(_page_sets(spark, sf_dir))
    d = TM.density(TM.term_frequency(TM.doc_tokens(docs_, stop()), (1,)), TOP_N)
    return d.select("set_id", "doc_id", "term", r6("density").alias("density"), "rank")


def _page_tfidf(n):
    sql = (_page_sql(O.HOST_DOCS_CTE, *O.tfidf_ctes(2, (n, n), TOP_N)) +
           "select * from (select set_id, doc_id, term, round(round(tfidf_score, 9), 6) as tfidf_score, "
           "cast(row_number() over (partition by set_id, doc_id order by round(tfidf_score, 9) desc, term) "
           f"as integer) as rank from sc) where rank <= {TOP_N}")

    def q(spark, sf_dir):
        t = TF.analyze_ngrams(_page_sets(spark, sf_dir), (n, n), TOP_N)
        # scores that are equal but for the order of addition must tie on both sides
        t = TF.ranked(t.withColumn("tfidf_score", F.round("tfidf_score", 9)), TOP_N)
        return t.select("set_id", "doc_id", "term", r6("tfidf_score").alias("tfidf_score"), "rank")
    register("page_tfidf_ngrams" if n == 1 else f"page_tfidf_ngrams_{n}", sql)(q)


for _n in (1, 2, 3):
    _page_tfidf(_n)


# ---------------------------------------------------------------- rest of the partial operators

@register("table_stopword_tokens", O.with_ctes(O.DOCS_CTE, "sw as (select distinct lower(" + O.strip_sql("w") +
          ") as w from (select unnest(string_split(text, ' ')) as w from benchmark) where " + O.strip_sql("w") +
          " <> '')", "al as (select doc_id, unnest(g) as x, generate_subscripts(g, 1) as i from (select doc_id, " +
          O.tokens_sql("text", stop=False) + " as g from docs))") +
          "select docs.doc_id, coalesce(t.tokens, '') as tokens from docs left join (select doc_id, "
          "string_agg(x, ' ' order by i) as tokens from al where x not in (select w from sw) group by doc_id) t "
          "on docs.doc_id = t.doc_id")
def q_table_stopword_tokens(spark, sf_dir):
    """S7/T10 with a stopword table of any length (here the words of ``benchmark``)."""
    lines = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", " ")).alias("value"))
    t = TM.doc_tokens(DS.read_documents(spark, sf_dir), SW.stopwords_table(spark, lines=lines),
                      by_doc=False)
    return t.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@register("comparison_report", COVERAGE_SQL + ", gaps as (" + O.gap_sql(100) + "), gl as (select set_id, n, "
          "string_agg(term || '=' || frequency, '|' order by rank) as gap_terms from gaps group by set_id, n) "
          "select cov.set_id, cov.n, common_terms_count, round(case when total_competitor_unique_terms > 0 "
          "then common_terms_count * 100.0 / total_competitor_unique_terms else 0 end, 6) "
          "as coverage_percentage, total_competitor_unique_terms, total_target_terms, "
          "coalesce(gap_terms, '') as gap_terms from cov left join gl on cov.set_id = gl.set_id and cov.n = gl.n "
          "where total_competitor_unique_terms + total_target_terms > 0")
def q_comparison_report(spark, sf_dir):
    """C6 with its list of the 100 most frequent gap terms."""
    _, t = set_terms(spark, sf_dir)
    c = CM.comparison_report(CM.run_stats(t))
    pairs = F.transform("gap_terms", lambda g: F.concat(g["term"], F.lit("="), g["frequency"].cast("string")))
    return c.withColumn("coverage_percentage", r6("coverage_percentage")).withColumn(
        "gap_terms", F.array_join(pairs, "|"))


@register("given_names", O.with_ctes(O.DOCS_CTE) +
          "select set_id, name, max(doc_id) as doc_id from (select docs.set_id, docs.doc_id, d.lang as name "
          "from docs join documents d on docs.doc_id = d.doc_id qualify docs.ord < max(docs.ord) over "
          "(partition by docs.set_id)) group by set_id, name")
def q_given_names(spark, sf_dir):
    """D2 with given names (here the language), one for every document of a set but
    its last, which is cut off; equal names collapse."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("source").alias("set_id"), "doc_id", F.col("lang").alias("name"))
    ordered = DS.with_ordinal(raw)
    ends = ordered.groupBy("set_id").agg(F.max("ord").alias("_end"))
    names = ordered.join(ends, "set_id").filter(F.col("ord") < F.col("_end")).select("set_id", "ord", "name")
    return CM.given_names(ordered.drop("name"), names).select("set_id", "name", "doc_id")


@register("language_labels", "with e as (select source as set_id, lang, row_number() over (partition by source "
          "order by doc_id) - 1 as ord from documents) select set_id, lang, case when min(ord) = 0 then 'target' "
          "else 'Competitor ' || min(ord) end as label from e group by set_id, lang")
def q_language_labels(spark, sf_dir):
    """D4 over a key that repeats inside a set."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("set_id"), "doc_id", "lang")
    return CM.entry_labels(DS.with_ordinal(raw), key="lang").select("set_id", "lang", "label")


def _term_weights_query(n):
    sql = (O.with_ctes(O.DOCS_CTE, O.tokens_cte(), O.terms_cte((n,)), O.TF_CTE) +
           "select set_id, doc_id, term, frequency, rank, round(frequency * 1.0 / max(frequency) over "
           "(partition by set_id, doc_id), 6) as weight from (select set_id, doc_id, term, frequency, "
           "cast(row_number() over (partition by set_id, doc_id order by frequency desc, first_pos) as integer) "
           "as rank from tf) where rank <= 100")

    def q(spark, sf_dir):
        w = TM.term_weights(TM.term_frequency(doc_tokens(spark, sf_dir), (n,)), 100, 100)
        return w.select("set_id", "doc_id", "term", "frequency", "rank", r6("weight").alias("weight"))
    register(f"term_weights_{n}", sql)(q)


for _n in (2, 3):
    _term_weights_query(_n)


@register("top_scores", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(2, (1, 1), None)) +
          ", s as (select *, frequency * 1.0 / sum(frequency) over (partition by set_id, doc_id) as score from "
          "(select set_id, doc_id, term, tf as frequency, row_number() over (partition by set_id, doc_id "
          "order by tf desc, term) as r from rtf) where r <= 100) select * from (select set_id, doc_id, term, "
          "round(score, 6) as score, cast(row_number() over (partition by set_id, doc_id order by score desc, term) "
          "as integer) as rank from s) where rank <= 20")
def q_top_scores(spark, sf_dir):
    """V11 over a table with a ``score`` column."""
    t = TF.ranked(TF.analyze_single_document(docs(spark, sf_dir), 100).drop("rank"), 20)
    return t.select("set_id", "doc_id", "term", r6("score").alias("score"), "rank")


@register("tfidf_gap_bars", O.with_ctes(O.DOCS_CTE, *O.tfidf_ctes(1, (1, 1), 200)) +
          ", g as (" + "select c.set_id, c.term, round(avg(c.tfidf_score), 9) as v from sc c "
          "where c.role = 'competitor' and not exists (select 1 from sc t where t.role = 'target' "
          "and t.set_id = c.set_id and t.term = c.term) and exists (select 1 from docs d where "
          "d.role = 'target' and d.set_id = c.set_id and " + O.nonblank_sql("d.text") + ") "
          "group by c.set_id, c.term), r as (select *, cast(row_number() over (partition by set_id order by v desc, "
          "term) as integer) as rank from g) select set_id, term, round(v, 6) as avg_tfidf_score, rank, "
          "cast(row_number() over (partition by set_id order by v, rank desc) as integer) as bar_order, "
          "round_even(v * 10000, 0) / 10000 as label from r where rank <= 20")
def q_tfidf_gap_bars(spark, sf_dir):
    """R4 over TF-IDF gap scores."""
    g = TF.tfidf_gap(doc_sets(spark, sf_dir), 200).withColumn("avg_tfidf_score", F.round("avg_tfidf_score", 9))
    b = RP.gap_bars(g, keys=("set_id",))
    return b.select("set_id", "term", r6("avg_tfidf_score").alias("avg_tfidf_score"), "rank", "bar_order", "label")
