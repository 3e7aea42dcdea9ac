"""Set aggregates over n-grams packed by position: the same rows, fewer and smaller ones moved."""

import pytest
from pyspark.sql import functions as F

from termweave.operators import compare as CM
from termweave.operators import frequent as FQ
from termweave.operators import terms as TM
from termweave.operators import tfidf as TF
from termweave.plans import queries as Q
from termweave.sources import docsets as DS

SCHEMA = "set_id string, doc_id bigint, text string"
LOW, HIGH = -2 ** 63, 2 ** 63 - 1


@pytest.fixture
def sets(spark):
    rows = [("a", LOW, "w1 w2 w3 w1"), ("a", HIGH, "w9 w2 w3 w3 w3"), ("a", LOW + 1, "w3 w3 w9 w2 w3 "), ("a", 0, "x y"),
            ("a", 5, "w9 w2 x"), ("a", 5, "z y x z y"), ("a", None, "n1 n1 z y"), ("b c", 1, ""), ("b c", 2, "q"), ("b c", 3, "q r"),
            ("alone", 7, "w1 w2"), ("none", 1, None), ("", 1, "e"), ("", 2, "e f e f"), (None, 1, "lost"), ("a\0=b", 1, "u"), ("a\0=b", 2, "u v")]
    return DS.with_roles(spark.createDataFrame(rows, SCHEMA))


def tokens(sets):
    return TM.doc_tokens(sets.docs, None, min_length=1, keep=("role",))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("ns", [(1, 2, 3), (1,), (2,), (3,), (2, 4), (3, 1)])
def test_run_stats_are_the_term_stats(spark, sets, ns):
    toks = tokens(sets)
    want = CM.term_stats(TM.terms(toks, ns, keep=("role",))).withColumn(
        "first", F.col("first_doc").cast("decimal(20,0)") * CM.PLACES + F.col("first_pos"))
    cols = ("set_id", "n", "term", "frequency", "in_target", "in_competitors", F.col("first").cast("decimal(31,0)"))
    got = CM.run_stats(TM.runs(toks, ns, keep=("role",)), ns)
    assert rows(got) == rows(want.select(*cols)) != []
    assert rows(CM.gap_terms(got, 4).filter("set_id != 'a'")) == rows(CM.gap_terms(want.drop("first"), 4).filter("set_id != 'a'"))


def test_nothing_from_no_n_or_no_token(spark, sets):
    assert CM.run_stats(TM.runs(tokens(sets), (0,), keep=("role",)), (0,)).collect() == []
    assert TM.runs(tokens(DS.DocSets(sets.docs.limit(0))), keep=("role",)).collect() == []


def test_the_report_moves_its_runs_once(spark, sets):
    toks = tokens(sets)
    got = CM.comparison_report(CM.run_stats(TM.runs(toks, keep=("role",))))
    want = CM.comparison_report(CM.term_stats(TM.terms(toks, keep=("role",))))
    assert rows(got.filter("set_id != 'a'")) == rows(want.filter("set_id != 'a'")) != []
    assert rows(got.drop("gap_terms")) == rows(want.drop("gap_terms"))
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("posexplode") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("name", ["comparison_report", "coverage_bands", "gap_terms", "coverage", "common_terms", "competitor_bag", "gap_terms_pruned"])
def test_no_single_n_gram_is_dealt(spark, sf_dir, name):
    plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "n#" not in "".join(x.split("]")[0] for x in plan.splitlines() if "Exchange hashpartitioning" in x and "term#" in x)


@pytest.fixture
def hot(spark):
    rows = [("hot", k, f"alpha beta gamma alpha beta r{k}") for k in range(90)] + [("small", k, f"alpha s{k}") for k in range(4)]
    rows += [("hot", 3, "beta again"), ("hot", None, "alpha null"), ("small", 90, " "), ("small", 91, "! ?"), ("rare", 1, "x1 y1"), ("rare", 2, "x2")]
    return DS.with_roles(spark.createDataFrame(rows, SCHEMA))


def test_buckets_follow_the_size_of_their_set(spark, hot, monkeypatch):
    monkeypatch.setattr(FQ, "BUCKET_BYTES", 500)
    counts = FQ.bucket_totals(hot.docs, 2, (1, 2))
    found = {r[0]: r[1] for r in counts.groupBy("set_id").agg(F.countDistinct("bucket")).collect()}
    assert found["small"] == found["rare"] == 1 and 5 <= found["hot"] <= 9
    want = TF.vocabulary(TF.raw_ngram_counts(hot.docs, 2, (1, 2), ()), 3, ("set_id", "n"))
    got = FQ.frequent_terms(hot.texts, 3, 2, (1, 2))
    assert rows(got) == rows(want.select(got.columns)) != []


def test_a_bucket_without_stored_terms_still_lowers_the_threshold(spark):
    counts = spark.createDataFrame([("a", 0, 1, TF.MARK, 2), ("a", 1, 1, TF.MARK, 9), ("a", 0, 1, "x", 6), ("a", 1, 1, "y", 1)],
                                   "set_id string, bucket int, n int, term string, total bigint")
    stored = FQ.stored_totals(counts)
    assert sorted(r.term for r in stored.collect()) == [TF.MARK, TF.MARK, "x"]
    assert [tuple(r) for r in FQ.thresholds(stored, 1).collect()] == [("a", 1, 3.0)]
    assert FQ.thresholds(stored, 2).collect()[0].least == 0.0


def test_each_n_moves_no_rare_n_grams(spark, hot, monkeypatch):
    tf, by = TF.raw_ngram_counts(hot.docs, 2, (1, 2)), ("set_id", "n")
    want = TF.weights(tf, TF.idf(TF.vocabulary(tf, 4, by)), by=by)
    near = {c: F.round(c, 9) for c in ("weight", "tfidf_score")}
    want = rows(want.withColumns(near))
    assert rows(TF.analyze_each_n(DS.DocSets(hot.docs), (1, 2), 4).withColumns(near)) == want != []
    assert len(rows(TF.analyze_each_n(hot, (1, 2), None))) > len(want)
    monkeypatch.setattr(TF, "vocabulary", None)  # it deals every n-gram by its term
    assert rows(TF.analyze_each_n(hot, (1, 2), 4).withColumns(near)) == want
