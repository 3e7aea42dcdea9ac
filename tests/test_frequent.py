"""V1 by thresholds against the plain vocabulary and plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.operators import frequent as FQ
from termweave.operators import tfidf as TF

SCHEMA = "set_id string, doc_id bigint, text string"


def zipf_rows(seed, docs=120, words=400):
    """A hot set, small sets, ties, blank and null texts, and a set of rare terms only."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    weight = [1 / (i + 1) for i in range(words)]
    rows = [("hot" if k % 3 else f"s{k % 7}", k * 7919 - 50_000, " ".join(rng.choices(vocab, weight, k=rng.randint(0, 60))))
            for k in range(docs)]
    rows += [("hot", 10 ** 12, " \n "), ("hot", 10 ** 12 + 1, None), ("hot", 10 ** 12 + 2, "! ?"), ("blank", 1, "  "),
             ("ties", 1, "bb aa"), ("ties", 2, "cc dd"), ("ties", 3, "ee aa"), ("one", 1, "aa")]
    return rows + [("rare", k, f"x{k} y{k} z{k}") for k in range(40)]


def slow_cut(rows, k, n):
    totals, df, docs = {}, {}, Counter()
    for s, _, text in rows:
        if not (text or "").strip():
            continue
        docs[s] += 1
        w = [x for x in re.findall(r"\w+", text.lower()) if len(x) >= 2]
        grams = Counter(" ".join(w[i:i + n]) for i in range(len(w) - n + 1))
        totals.setdefault(s, Counter()).update(grams)
        df.setdefault(s, Counter()).update(grams.keys())
    return {(s, n, t, c, df[s][t], docs[s], r) for s in totals
            for r, (t, c) in enumerate(sorted(totals[s].items(), key=lambda x: (-x[1], x[0]))[:k], 1)}


@pytest.mark.parametrize("seed,k,buckets", [(1, 5, 3), (2, 20, 8), (3, 1, 50), (4, 1000, 4)])
def test_equals_plain_python_ties_and_blanks_included(spark, seed, k, buckets):
    rows = zipf_rows(seed)
    got = FQ.frequent_terms(spark.createDataFrame(rows, SCHEMA), k, 2, (1, 2), buckets).collect()
    cols = ("set_id", "n", "term", "total", "df", "n_docs", "rank")
    assert {tuple(r[c] for c in cols) for r in got} == slow_cut(rows, k, 1) | slow_cut(rows, k, 2)


def test_equals_the_plain_vocabulary(spark):
    d = spark.createDataFrame(zipf_rows(9), SCHEMA)
    a = FQ.frequent_terms(d, 10, 2, (1, 2, 3))
    b = TF.vocabulary(TF.raw_ngram_counts(d, 2, (1, 2, 3), ()), 10, ("set_id", "n")).select(a.columns)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()
    assert FQ.frequent_terms(d.limit(0), 10).count() == 0


def test_rare_terms_are_not_moved(spark):
    """Of a skewed vocabulary few counts pass; the bound is met by every term of the cut."""
    d = spark.createDataFrame([("a", k, " ".join(["alpha", "beta", "gamma"] * 5 + [f"r{k}x{i}" for i in range(50)]))
                               for k in range(64)], SCHEMA)
    counts = FQ.bucket_counts(d, 2, (1,), 4).cache()
    assert FQ.thresholds(counts, 3).collect()[0].least == 80.0  # 64 * 5 / 4
    assert {r.term for r in FQ.candidates(counts, FQ.stored_thresholds(counts, 3)).select("term").distinct().collect()} == {"alpha", "beta", "gamma"}
    # three words of three thousand, in four buckets, and the marker
    assert counts.count() > 3_000 and FQ.passing(counts, 3).filter(F.col("term") != TF.MARK).count() <= 4 * 5
    # a set without repeats has no bound: all its counts pass
    flat = FQ.bucket_counts(spark.createDataFrame([("a", k, f"x{k} y{k}") for k in range(30)], SCHEMA), 2, (1,), 4)
    assert FQ.candidates(flat, FQ.stored_thresholds(flat, 5)).count() == 0 and FQ.passing(flat, 5).filter(F.col("term") != TF.MARK).count() == 60


def test_tokens_are_exchanged_once_and_counts_stay_in_place(spark):
    d = spark.createDataFrame(zipf_rows(5), SCHEMA)
    plan = FQ.bucket_counts(d, 2, (1, 2, 3), 4)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1
