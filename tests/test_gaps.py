"""C2 by buckets against ``compare.gap_terms`` and plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.operators import compare as CM
from termweave.operators import gaps as GP
from termweave.operators import terms as TM
from termweave.sources.docsets import with_roles

SCHEMA = "set_id string, doc_id bigint, text string"


def word(i):
    return "".join("abcdefghij"[int(d)] for d in f"{i:03d}")


def rows_of(seed, docs=150):
    """A hot set, small sets, sparse and negative ids, blank targets, texts of no word."""
    rng = random.Random(seed)
    rows = [("hot" if k % 3 else f"s{k % 5}", (k - 40) * 7919 * 10 ** 9,
             " ".join(word(min(int(rng.expovariate(0.03)), 999)) for _ in range(rng.randint(0, 60)))) for k in range(docs)]
    rows += [("blank", 1, "  "), ("blank", 2, "abc abd abc"), ("null", -5, None), ("null", 7, "abd abc"),
             ("alone", 3, "abc abd"), ("same", 1, "abc abd"), ("same", 2, "abd abc abd"), ("ties", 1, "zzz"),
             ("ties", 2, "bbb aaa"), ("ties", 3, "ccc aaa bbb")]
    rng.shuffle(rows)
    return rows


def slow_gaps(rows, ns, k):
    out = set()
    for s in {r[0] for r in rows}:
        mine = sorted((d, re.findall(r"[a-z]+", t or "")) for s2, d, t in rows if s2 == s)
        for n in ns:
            grams = [[" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] for _, w in mine]
            bag = [g for doc in grams[1:] for g in doc if g not in set(grams[0])]
            first = {g: i for i, g in reversed(list(enumerate(bag)))}
            best = sorted(Counter(bag).items(), key=lambda x: (-x[1], first[x[0]]))[:k]
            out |= {(s, n, t, c, r) for r, (t, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed,k,per", [(1, 5, 7), (2, 50, 1), (3, 10_000, 30), (4, 3, 10_000)])
def test_equals_plain_python_with_any_number_of_buckets(spark, seed, k, per):
    rows = rows_of(seed)
    docs = with_roles(spark.createDataFrame(rows, SCHEMA)).docs
    got = GP.pruned_gap_terms(docs, None, (1, 2, 3), k, per).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r.set_id, r.n, r.term, r.frequency, r["rank"]) for r in got} == slow_gaps(rows, (1, 2, 3), k)


def test_equals_the_plain_operator_with_repeats_and_stopwords(spark):
    base = spark.createDataFrame(rows_of(7), SCHEMA)
    docs = with_roles(base).docs
    docs = docs.unionByName(docs.limit(20)).withColumn("bucket", F.lit("clash")).withColumn("_n", F.lit(9))
    stop = [word(0), word(3)]
    plain = CM.gap_terms(CM.term_stats(TM.terms(TM.doc_tokens(docs, stop, keep=("role",)), (1, 2), keep=("role",))), 20)
    pruned = GP.pruned_gap_terms(docs, stop, (1, 2), 20, 10)
    assert plain.exceptAll(pruned).count() == pruned.exceptAll(plain).count() == 0 < plain.count()
    assert GP.pruned_gap_terms(docs.limit(0), stop).count() == 0


def test_hot_set_is_spread_and_shared_terms_stay(spark):
    rows = [("hot", k, f"abc abd x{word(k)}") for k in range(600)] + [("small", k, "abc abe") for k in range(5)]
    docs = with_roles(spark.createDataFrame(rows, SCHEMA)).docs
    dealt = GP.dealt_tokens(docs, None, 50).cache()
    most = dealt.groupBy("set_id", "bucket").count().groupBy("set_id").agg(F.max("count"), F.count("*")).collect()
    seen = {r[0]: (r[1], r[2]) for r in most}
    assert seen["hot"][1] == 12 and seen["hot"][0] < 100
    assert dealt.filter("set_id = 'hot' and role = 'target'").count() == 12
    # 599 words of one document each; "abc" and "abd" of all documents are not moved
    left = GP.bucket_stats(dealt, (1,)).filter("in_competitors and not in_target")
    assert left.count() == 599 and GP.gap_stats(dealt, (1,)).count() == 599


def test_counts_inside_a_bucket_need_no_exchange(spark):
    docs = with_roles(spark.createDataFrame(rows_of(2), SCHEMA)).docs
    stats = GP.bucket_stats(GP.dealt_tokens(docs, None), (1, 2, 3))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(set_id#\d+, bucket#\d+", plan)) == 1
    assert not re.search(r"Exchange hashpartitioning\([^)]*term#", plan)
