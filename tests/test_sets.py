"""Frequency, comparison and TF-IDF operators on hand-made sets (FIXTURES section 3)."""

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from termweave.operators import compare as CM
from termweave.operators import terms as TM
from termweave.operators import tfidf as TF
from termweave.sources.docsets import DocSets, with_ordinal, with_roles
from termweave.sources.ordinals import counts_before


def sets_of(spark, rows):
    df = spark.createDataFrame(rows, "set_id string, doc_id bigint, text string")
    return with_roles(df)


def test_frequency_tie_first_seen(spark):
    s = sets_of(spark, [("a", 1, "bb aa bb aa cc")])
    tf = TM.term_frequency(TM.doc_tokens(s.docs, None), (1,))
    got = [r.term for r in TM.top_terms(tf, 10).orderBy("rank").collect()]
    assert got == ["bb", "aa", "cc"]


def test_density_sums_to_100_and_empty(spark):
    s = sets_of(spark, [("a", 1, "xx yy xx zz"), ("a", 2, "le la les")])
    tf = TM.term_frequency(TM.doc_tokens(s.docs, ["le", "la", "les"]), (1,))
    d = TM.density(tf, None).collect()
    assert {r.doc_id for r in d} == {1}
    assert abs(sum(r.density for r in d) - 100.0) < 1e-9


def gaps_and_summary(spark, rows, stop=None):
    s = sets_of(spark, rows)
    toks = TM.doc_tokens(s.docs, stop, keep=("role",), by_doc=False)
    st = CM.term_stats(TM.terms(toks, (1,), keep=("role",)))
    return s, CM.gap_terms(st, None), CM.comparison_summary(st, s, (1,))


def test_gap_blank_target_and_order(spark):
    _, g, summ = gaps_and_summary(spark, [("a", 1, "   "), ("a", 2, "qq rr qq"), ("a", 3, "rr ss")])
    got = [(r.term, r.frequency) for r in g.orderBy("rank").collect()]
    # blank target: every competitor term is a gap; ties by first occurrence (ord, pos)
    assert got == [("qq", 2), ("rr", 2), ("ss", 1)]
    r = summ.first()
    assert r.common_terms_count == 0 and r.coverage_percentage == 0.0
    assert r.total_competitor_unique_terms == 3


def test_coverage_zero_without_competitor_terms(spark):
    _, g, summ = gaps_and_summary(spark, [("a", 1, "xx yy"), ("a", 2, "!!!")])
    assert g.count() == 0
    r = summ.first()
    assert r.coverage_percentage == 0.0 and r.total_target_terms == 2


def test_coverage_value(spark):
    _, g, summ = gaps_and_summary(spark, [("a", 1, "xx yy"), ("a", 2, "xx zz"), ("a", 3, "ww xx")])
    r = summ.first()
    assert r.common_terms_count == 1 and r.total_competitor_unique_terms == 3
    assert abs(r.coverage_percentage - 100.0 / 3) < 1e-9
    assert {x.term for x in g.collect()} == {"zz", "ww"}


def py_tfidf(docs, max_features):
    """Plain-Python TF-IDF of the spec (tokeniser A, cut, smoothed idf, L2)."""
    import re
    from collections import Counter

    live = {k: v for k, v in docs.items() if v and v.strip()}
    tfs = {k: Counter(re.findall(r"\w+", v.lower())) for k, v in live.items()}
    tot = Counter()
    for c in tfs.values():
        tot.update(c)
    vocab = [t for t, _ in sorted(tot.items(), key=lambda x: (-x[1], x[0]))[:max_features]]
    n = len(live)
    dfc = {t: sum(1 for c in tfs.values() if t in c) for t in vocab}
    out = {}
    for k, c in tfs.items():
        w = {t: c[t] * (math.log((1 + n) / (1 + dfc[t])) + 1) for t in vocab if c[t]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[k] = {t: x / norm for t, x in w.items()}
    return out


def test_tfidf_against_python(spark):
    docs = {1: "the cat sat on the mat", 2: "the dog sat", 3: "cats and dogs", 4: "   ", 5: "!!!"}
    s = sets_of(spark, [("a", k, v) for k, v in docs.items()])
    got = TF.analyze_multiple_documents(s, 4).collect()
    want = py_tfidf(docs, 4)
    assert {(r.doc_id, r.term) for r in got} == {(k, t) for k, v in want.items() for t in v}
    for r in got:
        assert abs(r.tfidf_score - want[r.doc_id][r.term]) < 1e-12
    # L2 norm of each document's kept scores is 1
    norms = {}
    for r in got:
        norms[r.doc_id] = norms.get(r.doc_id, 0.0) + r.tfidf_score ** 2
    assert all(abs(v - 1.0) < 1e-12 for v in norms.values())


def test_tfidf_gap_mean_over_having_competitors(spark):
    docs = [("a", 1, "alpha beta"), ("a", 2, "gamma alpha"), ("a", 3, "delta"), ("a", 4, "alpha")]
    s = sets_of(spark, docs)
    scores = {(r.doc_id, r.term): r.tfidf_score for r in TF.analyze_multiple_documents(s).collect()}
    g = {r.term: r for r in TF.tfidf_gap(s).collect()}
    assert set(g) == {"gamma", "delta"}
    assert abs(g["gamma"].avg_tfidf_score - scores[(2, "gamma")]) < 1e-12
    assert g["gamma"].competitors == 1


def test_tfidf_gap_blank_target_is_empty(spark):
    s = sets_of(spark, [("a", 1, " "), ("a", 2, "gamma alpha")])
    assert TF.tfidf_gap(s).count() == 0


def test_empty_vocabulary_no_rows(spark):
    s = sets_of(spark, [("a", 1, "a b c"), ("a", 2, "d e")])
    assert TF.analyze_ngrams(s, (1, 1), 10).count() == 0
    assert TF.analyze_single_document(s.docs, 10).count() == 0


def test_single_document_scores(spark):
    s = sets_of(spark, [("a", 1, "aa bb aa cc aa bb")])
    rows = TF.analyze_single_document(s.docs, 2).orderBy("rank").collect()
    assert [(r.term, r.frequency) for r in rows] == [("aa", 3), ("bb", 2)]
    assert abs(sum(r.score for r in rows) - 1.0) < 1e-12


def test_ordinal_matches_row_number_with_hot_group(spark):
    rows = [("hot", i) for i in range(0, 3000, 3)] + [(f"g{i % 7}", i) for i in range(1, 700, 3)]
    df = spark.createDataFrame(rows, "set_id string, doc_id bigint").repartition(5)
    got = {(r.set_id, r.doc_id): r.ord for r in with_ordinal(df).collect()}
    w = Window.partitionBy("set_id").orderBy("doc_id")
    want = {(r.set_id, r.doc_id): r.o for r in
            df.select("set_id", "doc_id", (F.row_number().over(w) - 1).alias("o")).collect()}
    assert got == want


def test_ordinal_on_random_ids_and_their_ends(spark):
    rng = random.Random(3)
    ids = {rng.randrange(-(1 << 63), 1 << 63) for _ in range(2500)} | {-(1 << 63), (1 << 63) - 1, -1, 0, 1}
    ids |= {k << 14 for k in range(20)} | {(1 << 42) + k for k in range(20)}
    rows = [("hot" if k % 3 else f"g{k % 50}", i) for k, i in enumerate(sorted(ids))]
    df = spark.createDataFrame(rows, "set_id string, doc_id bigint").repartition(6)
    seen, want = {}, {}
    for g, i in rows:
        want[g, i] = seen[g] = seen.get(g, -1) + 1
    assert {(r.set_id, r.doc_id): r.ord for r in with_ordinal(df).collect()} == want


@pytest.mark.parametrize("bits", [2, 5])
def test_counts_before_in_small_slices(spark, bits):
    rng = random.Random(bits)
    rows = [(f"g{k % 3}", v, rng.randint(1, 9)) for k, v in enumerate(rng.sample(range(-500, 500), 300))]
    df = spark.createDataFrame(rows, "g string, v bigint, n bigint")
    got = {(r.g, r.v): r.before for r in counts_before(df, ["g"], "v", "n", bits=bits, width=12).collect()}
    assert got == {(g, v): sum(n for h, u, n in rows if h == g and u < v) for g, v, _ in rows}


def _window_sizes(df):
    """Largest window partition a plan with these keys can see: the windows' keys."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)


def test_ordinal_windows_never_run_over_a_whole_set(spark):
    df = spark.createDataFrame([("a", 1)], "set_id string, doc_id bigint")
    keys = _window_sizes(with_ordinal(df))
    assert len(keys) == 5
    # only the top level, of at most 2 ** (64 - 56) slices, is keyed by the set alone
    assert sum("," not in k for k in keys) == 1


def test_roles(spark):
    s = sets_of(spark, [("a", 5, "x"), ("a", 3, "y"), ("b", 9, "z")])
    assert isinstance(s, DocSets)
    roles = {(r.set_id, r.doc_id): r.role for r in s.docs.collect()}
    assert roles == {("a", 3): "target", ("a", 5): "competitor", ("b", 9): "target"}


@pytest.mark.parametrize("rows_per_task", [1, 3, 10 ** 6])
def test_weights_do_not_depend_on_the_salts(spark, rows_per_task):
    rng = random.Random(2)
    rows = [("hot", k, " ".join(["common", *rng.sample(["aa", "bb", "cc", "dd", "ee"], rng.randint(0, 4))]))
            for k in range(40)] + [("cold", 100, "aa bb"), ("cold", 101, "aa"), ("hot", 102, "  ")]
    s = sets_of(spark, rows)
    tf = TF.raw_term_counts(s.docs, 1)
    vocab = TF.vocabulary(tf, 4)
    got = TF.weights(tf, TF.idf(vocab), rows_per_task=rows_per_task).collect()
    want = {}
    for name in ("hot", "cold"):
        for k, scores in py_tfidf({k: t for g, k, t in rows if g == name}, 4).items():
            want.update({(name, k, t): v for t, v in scores.items()})
    assert {(r.set_id, r.doc_id, r.term) for r in got} == set(want)
    assert all(abs(r.tfidf_score - want[r.set_id, r.doc_id, r.term]) < 1e-12 for r in got)
    assert {(r.set_id, r.n_docs) for r in vocab.collect()} == {("hot", 40), ("cold", 2)}


def test_a_common_term_is_spread_in_proportion(spark):
    s = sets_of(spark, [("a", k, "common rare" if k == 7 else "common") for k in range(200)])
    tf = TF.raw_term_counts(s.docs, 1)
    table = spark.range(1).select(TF.salt_table(TF.vocabulary(tf, None), ("set_id",), 20).alias("t")).first().t
    assert len(table) == TF.SALT_SLOTS and sorted(table)[-2:] == [1, 10]


def test_tfidf_reads_each_text_once(spark):
    s = sets_of(spark, [("a", k, f"aa bb c{k}") for k in range(9)])
    out = TF.analyze_multiple_documents(s, 5)
    # one exchange of documents' texts in the logical plan's scan; N has no branch of its own
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("scalar-subquery")[0]
    assert main.count("regexp_extract_all") <= 2  # vocabulary and weights, from one exchange


def stop_rows(spark, rows, words, **kw):
    docs = spark.createDataFrame(rows, "set_id string, doc_id bigint, text string")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    return {(r.set_id, r.doc_id): r.tokens for r in TM.doc_tokens(docs, table, by_doc=False, **kw).collect()}


@pytest.mark.parametrize("size", [1, 1 << 12])
def test_table_stopwords_in_the_row(spark, monkeypatch, size):
    monkeypatch.setattr(TM, "FILTER_WORDS", size)  # one number: nearly every word is suspected
    rng = random.Random(size)
    letters = [f"w{k}" for k in range(400)]
    rows = [("a" if k % 3 else None, k if k % 7 else None, " ".join(rng.choices(letters, k=rng.randint(0, 30))))
            for k in range(1, 120)]
    rows = list({(s, d): (s, d, t) for s, d, t in rows}.values()) + [("b", 1, None), ("b", 2, "w1 w1")]
    words = {f"w{k}" for k in range(0, 400, 3)} | {"w1"}
    got = stop_rows(spark, rows, words)
    assert got == {(s, d): [w for w in (t or "").split() if w not in words] for s, d, t in rows}
    assert stop_rows(spark, rows, [])[("b", 2)] == ["w1", "w1"]


def test_table_stopwords_move_no_token_rows(spark):
    docs = spark.createDataFrame([("a", 1, "x yy")], "set_id string, doc_id bigint, text string")
    out = TM.doc_tokens(docs, spark.createDataFrame([("yy",)], "word string"), by_doc=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "posexplode" not in plan


def test_stopwords_fall_back_only_when_nothing_is_there(spark, tmp_path):
    from termweave.sources.stopwords import spark_default, stopwords_table

    some, none = tmp_path / "some.txt", tmp_path / "none.txt"
    some.write_text("Le\n la \n\nle\n")
    none.write_text(" \n")
    default = set(spark_default("french"))
    assert {r.word for r in stopwords_table(spark, str(some)).collect()} == {"le", "la"}
    assert {r.word for r in stopwords_table(spark, str(none)).collect()} == default
    with pytest.warns(UserWarning):
        assert {r.word for r in stopwords_table(spark, str(tmp_path / "missing")).collect()} == default
    plan = stopwords_table(spark, str(some))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_labels_print_as_c_does(spark):
    from termweave.operators.report import printed

    values = [k / 4000 for k in range(4001)] + [k / 20000 for k in range(20001)] + [-x / 4000 for x in range(300)]
    values += [0.125, 0.375, 2.5, 1e9 + 0.005, 123456.785, -0.001, 0.0, 99.995, 100.0, 1 / 3]
    rng = random.Random(1)
    values += [rng.uniform(-1e6, 1e6) for _ in range(2000)] + [rng.randrange(10 ** 8) / 1000 for _ in range(2000)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for decimals in (2, 3):
        for r in df.select("v", printed(F.col("v"), decimals).alias("s")).collect():
            assert r.s == f"{r.v:.{decimals}f}", (r.v, r.s)


def test_matrix_makes_the_scores_once(spark):
    from termweave.operators import report as RP

    scores = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 1, "y", 0.7), ("a", 2, "x", 0.9), ("a", 2, "z", 0.1),
                                    ("a", 3, "y", 0.7)], "set_id string, doc_id bigint, term string, tfidf_score double")
    got = {(r.doc_id, r.term, r.term_order): r.value for r in RP.comparison_matrix(scores, 2).collect()}
    assert got == {(1, "x", 1): 0.5, (1, "y", 2): 0.7, (2, "x", 1): 0.9, (2, "y", 2): 0.0, (3, "x", 1): 0.0,
                   (3, "y", 2): 0.7}
