"""Scoring operators (3, 4): held-out accuracy, their parts, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,least", [("op3_quality", "quality", 0.97), ("op4_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    joined = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    n, right = joined.agg(F.count("*"), F.count_if(F.col("predicted") == F.col(label))).first()
    assert n > 50 and right / n >= least
    assert got.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxicity_recall_and_precision_on_held_out_rows(spark):
    got = queries.QUERIES["op4_toxicity"](spark, SF).filter("held_out")
    n, found, right = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").agg(
        F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("predicted = 1")), F.count_if(F.expr("predicted = 1 AND toxic = 1"))).first()
    assert n > 10 and right / n >= 0.75 and right / found >= 0.9


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in quality.score(docs, x, allowed=~out).collect())
            for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edges(spark, op, label):
    docs = spark.createDataFrame([(None, "x"), (1, None), (2, ""), (3, "you stupid idiot, worthless scum"), (3, "a b"),
                                  (4, "word " * 40_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 1), (3, 0), (99, 0), (4, 0)],
                                   f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        out = op.score(docs, known, label_col=label)
        rows = out.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
        assert op.score(docs.limit(0), known, label_col=label).count() == 0


def test_isotonic():
    fit = quality.isotonic(np.ones(6), np.array([0.0, 0.5, 0.2, 0.8, 0.7, 1.0]))
    assert (np.diff(fit) >= 0).all() and np.allclose(fit, [0, 0.35, 0.35, 0.75, 0.75, 1])


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    m = quality.Model(np.zeros(quality.SIZE), np.ones(quality.SIZE))
    x = rng.normal(0, 0.4, (20, quality.SIZE))
    phi = m.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * quality.WIDTH ** 2))
    assert np.abs(phi @ phi.T - exact).max() < 0.3


@pytest.mark.parametrize("text", ["He met approx. two Americans.", "Die Frau bzw. der Mann kam.", "So Mr. de Gaulle left.",
                                  "It ended. then He left! so They stayed? and We too."])
def test_a_small_letter_after_a_full_stop_is_no_vote(text):
    assert toxicity.Voters({}).votes(text) == 0


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.2).astype(int)
    votes = np.stack([np.where(rng.random(4000) < 0.9, y, 1 - y), np.where(rng.random(4000) < 0.85, y, 1 - y),
                      rng.integers(0, 2, 4000)], axis=1).astype(float)
    q = toxicity.label_model(votes, y, np.ones(4000))
    w = toxicity.linear(votes, q, np.ones(4000))
    assert ((q > 0.5) == y).mean() > 0.95 and w[1] > 4 * abs(w[3]) and w[2] > 4 * abs(w[3])


def test_label_model_estimates_the_accuracy_of_the_labels():
    rng = np.random.default_rng(2)
    n = 8000
    y = rng.integers(0, 2, n)
    votes = np.stack([np.where(rng.random(n) < 0.85, y, 1 - y) for _ in range(4)], axis=1).astype(float)
    given = np.where(rng.random(n) < 0.75, y, 1 - y)  # right three times in four
    q = toxicity.label_model(votes, given, np.ones(n))
    split = votes.sum(axis=1) == 2  # the other voters say nothing
    assert abs(q[split & (given == 1)].mean() - 0.75) < 0.07 and abs(q[split & (given == 0)].mean() - 0.25) < 0.07
