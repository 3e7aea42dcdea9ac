"""Steps whose size must follow the input: partitions, filters, one-pass n-grams."""

import pytest
from pyspark.sql import functions as F

from termweave import session
from termweave.functions import text as T
from termweave.operators import compare as CM
from termweave.operators import frequent as FQ
from termweave.operators import terms as TM
from termweave.operators import tfidf as TF
from termweave.sources import docsets as DS

SCHEMA = "set_id string, doc_id bigint, text string"


@pytest.fixture
def stored(spark, tmp_path, monkeypatch):
    """Documents in a file that is large for its partitions (the bytes of one are few)."""
    rows = [(f"s{k % 3}", k, f"w{k % 5} w{k % 7} only{k} w{k % 5} été") for k in range(60)] + [("s1", 4, "again w4"), ("s2", 99, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(session, "BYTES_PER_PART", 100)
    return spark.read.parquet(str(tmp_path / "d"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_partitions_follow_the_input(spark, stored):
    n = session.parts(stored)
    assert n == -(-session.input_bytes(stored) // 100) > 4
    tf = TM.term_frequency(TM.doc_tokens(stored, None))
    assert f"{n}), REPARTITION_BY_NUM" in plan(tf) and plan(tf).count("Exchange") == 1
    stats = CM.term_stats(TM.terms(TM.doc_tokens(DS.with_roles(stored).docs, None, keep=("role",), by_doc=False), keep=("role",)))
    assert f"hashpartitioning(set_id#" in plan(stats) and plan(stats).count(f"{n}), REPARTITION_BY_NUM") >= 2


def test_partitions_of_unknown_input(spark):
    df = spark.createDataFrame([("a", 1, "x")], SCHEMA)
    assert session.parts(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_partitions_give_the_same_rows(spark, stored, monkeypatch):
    def rows():
        sets = DS.with_roles(stored)
        toks = TM.doc_tokens(sets.docs, None, keep=("role",), by_doc=False)
        return [sorted(map(tuple, d.collect()), key=str) for d in (
            CM.term_stats(TM.terms(toks, keep=("role",))), TM.top_terms(TM.term_frequency(TM.doc_tokens(stored, None)), 3),
            TF.analyze_each_n(sets, (1, 2), 5).withColumns({c: F.round(c, 9) for c in ("weight", "tfidf_score")}),
            FQ.frequent_terms(sets.docs, 4, 1, (1, 2)))]

    many = rows()
    monkeypatch.setattr(session, "BYTES_PER_PART", 1 << 40)
    assert many == rows() and all(many)


def test_grams_are_those_of_the_arrays(spark):
    df = spark.createDataFrame([("a", 1, ["x", "y", "x", "z"]), ("a", 2, []), ("a", 3, None), ("b", 4, ["q"])],
                               "set_id string, doc_id bigint, tokens array<string>")
    for n in (1, 2, 3, 5):
        want = [(r.doc_id, p, g) for r in df.select("doc_id", T.ngrams("tokens", n).alias("g")).collect() for p, g in enumerate(r.g or [])]
        got = [(r.doc_id, r.pos, r.term) for r in TM.terms(df, (n,)).collect()]
        assert sorted(got) == sorted(want)
    assert TM.terms(df, (0,)).collect() == []
    marked = TM.grams(df, (1, 2), ("doc_id",), "").filter("term = ''").collect()
    assert sorted((r.doc_id, r.n) for r in marked) == [(d, n) for d in (1, 2, 4) for n in (1, 2)]


def test_tokenize_is_the_cleaned_text_split(spark):
    texts = ["", None, "L'été à www.x.fr/é et a-b_c me@x.org CŒUR ß 12,5", "---", "x", "ÀÉİstanbul\nfoo\tbar"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for stop in (None, ["et", "été"]):
        for r in df.select(T.tokenize("text", stop).alias("a"), T.tokens_from_clean(T.clean_text("text"), stop).alias("b")).collect():
            assert r.a == r.b


def test_weights_make_the_vocabulary_once_and_drop_other_terms_before_the_count(spark, stored):
    sets = DS.with_roles(stored)
    tf = TF.raw_term_counts(sets.docs, 1)
    w = TF.weights(tf, TF.idf(TF.vocabulary(tf, 2)))
    assert "WindowGroupLimit" not in plan(w) and "Scan ExistingRDD" in plan(w)
    lines = plan(w).splitlines()
    kept = max(i for i, x in enumerate(lines) if "getbit" in x.lower() or "bit_get" in x.lower())
    assert kept > max(i for i, x in enumerate(lines) if "HashAggregate" in x and "partial_count(1)" in x and "doc_id" in x)
    assert all(len(r) <= 2 for r in w.groupBy("set_id").agg(F.collect_set("term").alias("t")).toPandas()["t"])


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scores(df):
    return sorted((tuple(r) for r in df.withColumns({c: F.round(c, 9) for c in df.columns if c in ("weight", "tfidf_score", "avg_tfidf_score")}).collect()), key=str)


def test_a_small_vocabulary_moves_no_counts(spark, stored):
    w = TF.analyze_multiple_documents(DS.with_roles(stored), 5)
    main = plan(w).split("Subquery")[0] + plan(w).split("Generate inline")[-1]
    assert "BroadcastHashJoin" in main and "term" not in "".join(x for x in main.splitlines() if "Exchange hashpartitioning" in x)
    assert main.count("REPARTITION_BY_NUM") <= 2  # the texts and, for the roles, their keys


def test_a_large_vocabulary_is_joined_in_as_many_partitions_as_the_input_needs(spark, stored, request):
    sets, n = DS.with_roles(stored), session.parts(stored)
    want = [scores(TF.analyze_multiple_documents(sets, 5)), scores(TF.tfidf_gap(sets, 5)), scores(TF.analyze_each_n(sets, (1, 2), 5))]
    request.getfixturevalue("no_broadcast")
    w = TF.analyze_multiple_documents(sets, 5)
    dealt = [x for x in plan(w).splitlines() if f"{n}), REPARTITION_BY_NUM" in x]
    assert any("_salt" in x for x in dealt) and "BroadcastHashJoin" not in plan(w)
    above = plan(w)[:plan(w).index("SortMergeJoin")]
    assert f"{n}), REPARTITION_BY_NUM" in above and "ENSURE_REQUIREMENTS" not in above
    assert want == [scores(w), scores(TF.tfidf_gap(sets, 5)), scores(TF.analyze_each_n(sets, (1, 2), 5))] and all(want)


@pytest.mark.parametrize("rows_per_task", [1, 3])
def test_salts_of_a_large_vocabulary_change_nothing(spark, stored, request, rows_per_task):
    tf = TF.raw_term_counts(DS.with_roles(stored).docs, 1)
    idf = TF.idf(TF.vocabulary(tf, 6, words=True))
    want = scores(TF.weights(tf, idf))
    request.getfixturevalue("no_broadcast")
    assert scores(TF.weights(tf, idf, rows_per_task=rows_per_task)) == want != []


def test_words_are_combined_before_they_move(spark, stored):
    more = spark.createDataFrame([("s0", None, "w1 null"), ("s0", None, "w1 w1"), (None, 3, "w2"), ("s9", 7, "  "), ("s1", 4, "été")], SCHEMA)
    for docs in (stored, stored.unionByName(more)):
        sets = DS.with_roles(docs)
        for k in (3, 200, None):
            v = TF.vocabulary(TF.raw_word_counts(sets, 1), k, words=True)
            assert scores(v) == scores(TF.vocabulary(TF.raw_term_counts(sets.docs, 1, keep=()), k)) != []
        lines = plan(v).splitlines()
        moved = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(set_id" in x and "term" in x]
        assert len(moved) == 1 and "partial_sum(tf" in "".join(lines[moved[0]:moved[0] + 3]) and "rangepartitioning" in plan(v)


def test_the_gap_reads_no_tokens_for_live_targets(spark, stored):
    g = TF.tfidf_gap(DS.with_roles(stored), 5)
    assert g._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
