"""Operator 4: toxicity by weak supervision.

Many voters look at a text: a lexicon of insults, lexicons of words and word
beginnings mined from the training rows in tiers of support, and patterns (an
insult addressed to the reader, shouting).  A
generative label model (a hidden class; the voters' rates given the class, the
labels of the training rows as one more, fallible voter) is fitted by EM on
the counts of vote patterns; voters that agree beyond what the class explains
are discounted by their correlation.  Its posteriors are the labels on which a
linear classifier of the votes is trained, which scores every document.

Mining and fitting use at most ``train_rows`` labelled rows (smallest hash of
the id); the mined lexicon holds every entry that stands in three toxic ones and
hardly in others, and there are at most ``2 ** voters`` patterns, so what reaches the
driver is bounded by the text of the training rows, not by the table.

Edge cases: null and empty texts get no votes and the lowest score; rows with a
null id or label are not trained on; without labelled rows the fixed lexicon
alone decides; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import checkpoint, map_texts, ship_package
from termweave.llm.quality import chosen_labels

TRAIN_ROWS = 30_000
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
# A plain lexicon of insults.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless "
                    "disgusting clown fool imbecile vermin filth hate jerk freak".split())
SHOUT = re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b|!!")
ADDRESS = re.compile(r"\byou(?:'re| are)? (?:all )?(?:an? )?(?:" + "|".join(sorted(INSULTS)) + r")\b", re.I)
# Tiers of a mined entry, by the share of toxic training rows it stands in.
TIERS = (0.05, 0.01, 0.0)
VOTERS = ("insult", "address", "strong word", "strong beginning of 4", "strong beginning of 5",
          "strong beginning of 6", "middling entry", "weak entry", "two entries", "shouting")
MEMORY = 100_000


def entries(word: str) -> list[str]:
    """What the miner counts for a word: itself and its beginnings."""
    return ["=" + word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


class Voters:
    """Votes of one text as bits, by ``VOTERS``; ``mined`` maps entries to tiers."""

    def __init__(self, mined: dict[str, int]):
        self.mined = mined
        self.memory: dict[str, int] = {}

    def word(self, word: str) -> int:
        bits = 1 if word in INSULTS else 0
        for e in entries(word):
            tier = self.mined.get(e)
            if tier == 0:
                bits |= 4 if e[0] == "=" else 8 << (len(e) - 5)
            elif tier is not None:
                bits |= 64 if tier == 1 else 128
        return bits

    def votes(self, text: str | None) -> int:
        text = text or ""
        memory, bits, several = self.memory, 0, 0
        for w in set(WORD.findall(text.lower())):
            got = memory.get(w)
            if got is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                got = memory[w] = self.word(w)
            if got:
                bits |= got
                several += got & ~128 > 0
        if bits & 1 and ADDRESS.search(text):
            bits |= 2
        return bits | (256 if several > 1 else 0) | (512 if SHOUT.search(text) else 0)


def mine(train: DataFrame) -> dict[str, int]:
    """Entries that stand in toxic training rows and hardly in others, with tiers."""

    def count(batches):
        toxic, clean = Counter(), Counter()

        def flush():
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string()),
                                              "t": pa.array([toxic[k] for k in keys], pa.int64()),
                                              "c": pa.array([clean[k] for k in keys], pa.int64())})
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = {e for w in set(WORD.findall((text or "").lower())) for e in entries(w)}
                    (toxic if y >= 0.5 else clean).update(found)
                if len(toxic) + len(clean) > 300_000:
                    yield flush()
        yield flush()

    n = train.agg(F.count("*"), F.count_if(F.col("label") >= 0.5)).first()
    if not n[1]:
        return {}
    counts = (train.select("text", "label").mapInArrow(count, "entry string, t long, c long")
              .groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    # at least three rows, and twenty times likelier in a toxic row than in another
    rate = F.lit((n[0] - n[1]) / n[1])
    rows = (counts.filter((F.col("t") >= 3) & (F.col("t") * rate >= 20 * F.col("c")))
            .collect())  # each stands in three of at most ``train_rows`` rows
    return {r["entry"]: next(k for k, share in enumerate(TIERS) if r["t"] >= share * n[1]) for r in rows}


def label_model(votes: np.ndarray, given: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of the class for each (vote row, given label), by EM; ``given`` is
    the training label, one more voter, from which the EM starts."""
    votes = np.hstack([votes, given[:, None]])
    q = np.where(given == 1, 0.95, 0.05)
    for _ in range(30):
        rate, prior = [], []
        for y in (0, 1):
            w = counts * (q if y else 1 - q)
            rate.append((w @ votes + 0.5) / (w.sum() + 1))
            prior.append((w.sum() + 1) / (counts.sum() + 2))
        discount = 1 / (1 + _agreement(votes, counts, q, rate))
        logit = np.tile(np.log(prior), (len(votes), 1))
        for y in (0, 1):
            each = votes * np.log(rate[y]) + (1 - votes) * np.log(1 - rate[y])
            logit[:, y] += each @ discount
        q = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -50, 50)))
    return q


def _agreement(votes, counts, q, rate) -> np.ndarray:
    """For each voter, the sum of its positive correlations with the others given
    the class."""
    total = np.zeros(votes.shape[1])
    for y in (0, 1):
        w = counts * (q if y else 1 - q)
        x = votes - rate[y]
        cov = (x * w[:, None]).T @ x / max(w.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        total += (rho.sum(axis=1) - np.diag(rho)) / 2
    return total


def linear(votes: np.ndarray, target: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (bias first) of a logistic regression on soft labels."""
    x = np.hstack([np.ones((len(votes), 1)), votes])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = counts * np.maximum(p * (1 - p), 1e-6)
        w += np.clip(np.linalg.solve((x * s[:, None]).T @ x + ridge, x.T @ (counts * (target - p)) - ridge @ w), -4, 4)
    return w


def bits_of(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


def add_votes(df: DataFrame, mined: dict[str, int], text_col: str = "text") -> DataFrame:
    def make():
        v = Voters(mined)
        return lambda texts: [[v.votes(t) for t in texts]]

    return map_texts(df, text_col, "votes int", make)


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", allowed: F.Column | None = None,
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, votes, score)`` for every row; ``allowed`` says which label rows may
    be learned from."""
    ship_package(df.sparkSession)
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    picked = chosen_labels(labels, label_col, F.lit(True) if allowed is None else allowed, train_rows)
    train = checkpoint(rows.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # at most train_rows
                       .select("text", F.when(F.col("label") >= 0.5, 1).otherwise(0).alias("label")))
    mined = mine(train)
    seen = add_votes(train, mined).groupBy("votes", "label").count().collect()  # at most two for each pattern
    if seen:
        votes = bits_of(np.array([r["votes"] for r in seen]))
        counts = np.array([r["count"] for r in seen], float)
        q = label_model(votes, np.array([r["label"] for r in seen]), counts)
        weights = linear(votes, q, counts)
    else:
        weights = np.array([-3.0, 6.0] + [0.0] * (len(VOTERS) - 1))
    table = 1 / (1 + np.exp(-(bits_of(np.arange(1 << len(VOTERS))) @ weights[1:] + weights[0])))

    def make():
        v = Voters(mined)

        def apply(texts):
            got = [v.votes(t) for t in texts]
            return [got, table[got] if got else []]
        return apply

    return map_texts(rows, "text", "votes int, score double", make).select("doc_id", "votes", "score")
