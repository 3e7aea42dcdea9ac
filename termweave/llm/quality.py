"""Operator 3: quality classifier by random Fourier features.

A document is a dozen statistics of its text.  Random cosines of the
standardised statistics approximate a Gaussian kernel; ridge regression on
them is fitted by normal equations summed by partition, and an isotonic fit on
the training rows turns its output into a probability.

Training takes at most ``train_rows`` labelled rows (those with the smallest
hash of the id, so the choice does not depend on the layout); every document is
scored.  What reaches the driver is fixed in size: the statistics' moments, one
matrix of the features' size and the counts of ``BINS`` bins.

Edge cases: a null text counts as empty; rows with a null id or label, and labels
of unknown documents, are not trained on; several labels of one id are averaged;
without labelled rows every score is 0.5; repeated rows score alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import checkpoint, map_texts, ship_package
from termweave.llm.rules import Document

TRAIN_ROWS = 20_000
FEATURES, WIDTH, RIDGE, SEED, BINS = 256, 2.5, 1e-3, 11, 512


def statistics(text: str | None) -> list[float]:
    """Statistics of one text; none depends on its language or origin."""
    d = Document(text)
    n, chars = max(d.n_words, 1), max(len(d.text), 1)
    lines = max(len(d.lines), 1)
    distinct = len(set(d.words))
    digits = sum(map(d.text.count, "0123456789"))
    stops = sum(map(d.text.count, ".,;:!?"))
    upper = sum(map(str.isupper, d.text))
    return [math.log1p(d.n_words), math.log1p(lines), d.word_chars / n,
            math.log1p(10 * d.n_symbols / n), d.n_dup_lines / lines, d.n_repeat_words / n,
            distinct / n, math.log1p(distinct) - math.log1p(d.n_words) * 0.85,
            digits / chars, stops / n, upper / n, d.letters / max(d.word_chars, 1),
            math.log1p(n / lines), float(d.n_words == 0)]


SIZE = len(statistics(""))


def add_statistics(df: DataFrame, text_col: str = "text", out: str = "statistics") -> DataFrame:
    def make():
        return lambda texts: [[statistics(t) for t in texts]]

    return map_texts(df, text_col, f"`{out}` array<double>", make)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit (pool adjacent violators)."""
    pools: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist()):
        pools.append([w, m, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, m2, k2 = pools.pop()
            w1, m1, k1 = pools.pop()
            pools.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.repeat([p[1] for p in pools], [int(p[2]) for p in pools])


class Model:
    """Standardisation, random frequencies, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        phi = np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)
        return np.hstack([phi, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def chosen_labels(labels: DataFrame, label_col: str, allowed: F.Column, rows: int) -> DataFrame:
    """``(label_id, label)`` of at most ``rows`` ids with the smallest hash."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & allowed)
            .groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(label_col).alias("label"))
            .orderBy(F.xxhash64("label_id"), "label_id").limit(rows))


def fit(train: DataFrame, stats: str = "statistics", label: str = "label") -> Model | None:
    """Fit on a DataFrame of statistics and labels; None without rows."""
    ship_package(train.sparkSession)
    parts = [f(F.col(stats)[i]) for i in range(SIZE) for f in (F.avg, F.stddev_pop)]
    moments = train.agg(F.count("*"), *parts).first()
    if not moments[0]:
        return None
    scale = np.array(moments[2::2], float)
    model = Model(np.array(moments[1::2], float), np.where(scale > 1e-9, scale, 1.0))
    k = FEATURES + 1

    def normal(batches):
        total = np.zeros((k, k + 1))
        for batch in batches:
            phi = model.features(_matrix(batch.column(0)))
            total[:, :k] += phi.T @ phi
            total[:, k] += phi.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(k), pa.int32()),
                                          "row": pa.array(list(total), pa.list_(pa.float64()))})

    def add(group: pa.Table) -> pa.Table:
        total = _matrix(group.column("row")).sum(axis=0)
        return pa.table({"i": group.column("i")[:1], "row": pa.array([total], pa.list_(pa.float64()))})

    rows = (train.select(stats, label).mapInArrow(normal, "i int, row array<double>")
            .groupBy("i").applyInArrow(add, "i int, row array<double>").collect())  # k rows of k + 1
    system = np.zeros((k, k + 1))
    for r in rows:
        system[r["i"]] = r["row"]
    model.beta = np.linalg.solve(system[:, :k] + RIDGE * moments[0] * np.eye(k), system[:, k])

    def binned(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            place = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(place), "raw": pa.array(raw), "y": batch.column(1)})

    bins = (train.select(stats, label).mapInArrow(binned, "bin int, raw double, y double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).orderBy("bin").collect())
    model.knots = np.array([r["raw"] for r in bins])
    model.levels = np.clip(isotonic(np.array([r["n"] for r in bins], float), np.array([r["y"] for r in bins])), 0, 1)
    return model


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", allowed: F.Column | None = None,
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, score)`` for every row; ``allowed`` says which label rows may be
    learned from."""
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    known = checkpoint(add_statistics(rows).select("doc_id", "statistics"))
    picked = chosen_labels(labels, label_col, F.lit(True) if allowed is None else allowed, train_rows)
    train = checkpoint(known.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # at most train_rows
                       .select("statistics", "label"))
    model = fit(train)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            got = model.score(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = known.schema["doc_id"].dataType.simpleString()
    return known.mapInArrow(run, f"doc_id {kind}, score double")
