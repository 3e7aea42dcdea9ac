"""Page flows, stopword sources, reports and set operators on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from termweave.functions import markup
from termweave.operators import compare as CM
from termweave.operators import content as CT
from termweave.operators import report as RP
from termweave.operators import terms as TM
from termweave.operators import tfidf as TF
from termweave.plans import flows as FL
from termweave.sources import docsets as DS
from termweave.sources import pages as PG
from termweave.sources import stopwords as SW


def page(text):
    return f"<html><body><p>{text}</p></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.fr/t", page("chat chien")), (2, "http://a.fr/1", page("chat gare")),
            (3, "http://a.fr/2", None), (4, "http://a.fr/3", page("train train")),
            (5, "http://b.fr/t", "<html><body><div>x</div></body></html>"), (6, "http://b.fr/1", page("un deux")),
            (7, "http://b.fr/2", page("trois")), (8, "notaurl", page("x")), (9, "http:///x", page("y")),
            (10, "http://c.fr/t", page("seul")), (11, "http://a.fr/1", page("later copy"))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def entries(spark):
    rows = [("A", 0, "http://a.fr/t"), ("A", 1, "http://a.fr/2"), ("A", 2, "http://a.fr/1"), ("A", 3, "http://a.fr/1"),
            ("B", 0, "http://b.fr/t"), ("B", 1, "http://b.fr/1"), ("B", 2, "http://b.fr/2"),
            ("C", 0, "http://gone.fr/"), ("C", 1, "http://a.fr/1"), ("C", 2, "http://a.fr/3"),
            ("D", 0, "http://c.fr/t"), ("D", 1, "http://gone.fr/")]
    return spark.createDataFrame(rows, "set_id string, ord int, url string")


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_url_validity_and_errors(pages):
    got = dict(rows_of(PG.fetch_status(pages), "page_id", "error"))
    assert [k for k, v in sorted(got.items()) if v] == [3, 8, 9]
    assert set(v for v in got.values() if v) == {PG.FETCH_ERROR}


def test_dedupe_keeps_the_first_page_and_aggregates_no_markup(pages):
    out = PG.dedupe_by_url(pages)
    assert [r.page_id for r in out.filter("url = 'http://a.fr/1'").collect()] == [2]
    assert out.count() == 10
    for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines():
        assert "Aggregate" not in line or "html" not in line


def test_content_is_one_pass(pages):
    out = PG.content_with_status(pages)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert rows_of(out.filter("error is not null"), "page_id", "all_text") == [(3, ""), (8, ""), (9, "")]


def test_comparison_documents(spark, pages):
    sets = FL.comparison_documents(entries(spark), FL.loaded_content(pages))
    got = rows_of(sets.docs, "set_id", "ord", "role", "loaded", "text")
    assert got == [("A", 0, "target", True, "chat chien"), ("A", 2, "competitor", True, "chat gare"),
                   ("A", 3, "competitor", True, "chat gare"), ("B", 0, "target", True, ""),
                   ("B", 1, "competitor", True, "un deux"), ("B", 2, "competitor", True, "trois"),
                   ("C", 0, "target", False, ""), ("C", 1, "competitor", True, "chat gare"),
                   ("C", 2, "competitor", True, "train train")]  # D: one readable page


def test_set_metrics_count_loaded_pages(spark, pages):
    sets = FL.comparison_documents(entries(spark), FL.loaded_content(pages))
    got = rows_of(FL.comparison_metrics(sets, []), "set_id", "documents", "target_words", "competitor_words")
    # B: the empty target was read and counts; C: the missing one does not
    assert got == [("A", 2, 2, 4), ("B", 3, 0, 3), ("C", 2, 0, 4)]
    one = FL.distinct_url_docs(sets)
    assert rows_of(one.filter("set_id = 'A'"), "ord", "text") == [(0, "chat chien"), (2, "chat gare")]


def test_gaps_of_a_blank_target(spark, pages):
    sets = FL.comparison_documents(entries(spark), FL.loaded_content(pages))
    gaps = FL.comparison_gaps(sets, [], (1,), 10)
    assert rows_of(gaps.filter("set_id = 'B'"), "term") == [("deux",), ("trois",), ("un",)]
    assert rows_of(gaps.filter("set_id = 'A'"), "term", "frequency") == [("gare", 2)]
    assert rows_of(TF.tfidf_gap(sets), "set_id", "term", "competitors") == [("A", "gare", 2)]


def test_html_folder_source(spark, tmp_path):
    (tmp_path / "x.html").write_text(page("bonjour"), encoding="utf-8")
    (tmp_path / "y.txt").write_text("no")
    got = PG.read_html_folder(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].url.endswith("/x.html") and "bonjour" in got[0].html


@pytest.mark.parametrize("html,texts", [
    ("<p>a<template>T</template>b</p>", ["a", "b"]),
    ("<template><p>in</p></template><p>out</p>", ["out"]),
    ("<ruby>X<rp>(</rp><rt>kan</rt></ruby>", ["X"]),
    ("<p>a &foo; b &amp; c &#233; &eacute;</p>", ["a &foo b & c é é"]),
])
def test_markup_text_rules(html, texts):
    assert markup.parse_nodes(html)["texts"] == texts


def test_text_inside_a_template_is_no_body_text(spark):
    df = spark.createDataFrame([(1, "u", "<body><p>a</p><template><p>t</p></template></body>")],
                               "page_id long, url string, html string")
    assert CT.page_content(df).first().body_text == "a "


def test_rounding_is_that_of_the_binary_value(spark):
    v = spark.createDataFrame([(203 / 20000 * 100,), (3.125,), (1.015,), (2.5,)], "v double")
    assert [r[0] for r in v.select(RP.rounded(F.col("v"), 2)).collect()] == [1.01, 3.12, 1.01, 2.5]
    m = spark.createDataFrame([("s", 3.125, 7), ("t", 1.015, 8)], "set_id string, c double, k int")
    assert rows_of(RP.metric_labels(m), "set_id", "metric", "label") == sorted(
        [("s", "c", "%.2f" % 3.125), ("s", "k", "7"), ("t", "c", "%.2f" % 1.015), ("t", "k", "8")])


def test_density_bar_label_at_a_tie(spark):
    d = spark.createDataFrame([("s", 1, "x", 1.015, 1)], "set_id string, doc_id long, term string, density double, rank int")
    assert RP.density_bars(d).first().label == "1.01%"


def test_gap_bars_take_scores(spark):
    g = spark.createDataFrame([("s", "b", 0.5), ("s", "a", 0.5), ("s", "c", 0.9)], "set_id string, term string, avg_tfidf_score double")
    assert [r.term for r in RP.gap_bars(g, keys=("set_id",)).orderBy("bar_order").collect()] == ["b", "a", "c"]


def test_ranked_uses_either_score(spark):
    t = spark.createDataFrame([("s", 1, "b", 0.5), ("s", 1, "a", 0.5), ("s", 1, "c", 0.9)],
                              "set_id string, doc_id long, term string, score double")
    assert rows_of(TF.ranked(t, 2), "rank", "term") == [(1, "c"), (2, "a")]


def test_stopword_table_sources(spark, tmp_path):
    default = set(SW.spark_default("french"))
    words = lambda df: sorted(r.word for r in df.collect())
    assert set(words(SW.stopwords_table(spark))) == default
    assert set(words(SW.stopwords_table(spark, str(tmp_path / "missing.txt")))) == default
    (tmp_path / "blank.txt").write_text("\n  \n")
    assert set(words(SW.stopwords_table(spark, str(tmp_path / "blank.txt")))) == default
    (tmp_path / "two.txt").write_text(" Chat\nchat\n\nGARE \n", encoding="utf-8")
    assert words(SW.stopwords_table(spark, str(tmp_path / "two.txt"))) == ["chat", "gare"]


def test_a_stopword_table_of_any_length(spark):
    many = spark.range(150_000).select(F.concat(F.lit("W"), F.col("id")).alias("value"))
    docs = spark.createDataFrame([("s", 1, "w1 chat w149999 w150000 chat"), ("s", 2, "w5 w6"), ("s", 3, None)],
                                 "set_id string, doc_id long, text string")
    got = TM.doc_tokens(docs, SW.stopwords_table(spark, lines=many))
    assert rows_of(got, "doc_id", "tokens") == [(1, ["chat", "w150000", "chat"]), (2, []), (3, [])]


def test_given_names_zip_and_collapse(spark):
    docs = spark.createDataFrame([("s", k, 10 + k) for k in range(4)], "set_id string, ord int, doc_id long")
    names = spark.createDataFrame([("s", 0, "x"), ("s", 1, "y"), ("s", 2, "x")], "set_id string, ord int, name string")
    assert rows_of(CM.given_names(docs, names), "doc_id", "name") == [(11, "y"), (12, "x")]
    assert rows_of(CM.default_names(docs), "name")[0] == ("Competitor 1",)


def test_labels_of_repeated_keys(spark):
    e = spark.createDataFrame([("s", 0, "t"), ("s", 1, "a"), ("s", 2, "a"), ("s", 3, "t"), ("s", 4, "b")],
                              "set_id string, ord int, url string")
    assert rows_of(CM.entry_labels(e), "url", "label") == [("a", "Competitor 1"), ("b", "Competitor 4"), ("t", "target")]


def test_coverage_bands(spark):
    c = spark.createDataFrame([(49.9,), (50.0,), (75.0,), (90.0,)], "coverage_percentage double")
    got = CM.coverage_bands(c).collect()
    assert [r.band for r in got] == ["low", "mid", "high", "high"]
    assert [r.meets_threshold for r in got] == [False, False, False, True]


def test_plans_start_no_job(spark, sf_dir):
    """Roles, ordinals and page sets are plans only."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "building")
    d = DS.read_documents(spark, sf_dir)
    DS.with_ordinal(DS.with_roles(d).docs)
    p = PG.read_pages(spark, sf_dir)
    FL.comparison_documents(FL.page_entries(p), FL.loaded_content(p))
    jobs = tracker.getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # reading the two Parquet schemas


def test_set_invariants_and_partitioning(spark, sf_dir):
    """common + gap = distinct competitor terms; the layout does not matter."""
    seen = []
    for n in (1, 7):
        docs = DS.with_roles(DS.read_documents(spark, sf_dir).repartition(n)).docs
        stats = CM.term_stats(TM.terms(TM.doc_tokens(docs, [], keep=("role",)), (1, 2), keep=("role",)))
        gaps = {(r.set_id, r.n): r["count"] for r in CM.gap_terms(stats, None).groupBy("set_id", "n").count().collect()}
        rows = CM.comparison_summary(stats).collect()
        for r in rows:
            assert r.common_terms_count + gaps.get((r.set_id, r.n), 0) == r.total_competitor_unique_terms
        seen.append(sorted(map(tuple, rows)))
    assert seen[0] == seen[1]
