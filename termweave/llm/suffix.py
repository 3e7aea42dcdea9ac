"""Operator 9: suffix-array deduplication, blockwise, with a difference cover.

A string is ``window`` consecutive bytes of one document.  Every byte covered
by a string that also starts earlier (smaller id, or the same document at an
earlier byte) is removed; strings are judged on the input.

For a difference cover D modulo v, any two places i and j have a shift d < v
with (i + d) mod v and (j + d) mod v both in D.  So if the strings at i and j
are equal, two *cover samples* with equal prefixes of ``window - v + 1`` bytes
stand at one shift in both.

1. Only the cover samples (|D| of v suffixes) are ranked corpus-wide: a
   sample's prefix is met elsewhere or not.  This is the precomputed rank that
   resolves long ties, as far as deduplication needs it: two bits, the order
   inside a tie being that of the documents.
2. Suffixes with no shared sample within v bytes cannot tie over ``window`` bytes
   and are final.  The others are dealt to suffix buckets by their first
   ``window`` bytes (their 64-bit hash: equal prefixes meet, and nothing needs
   the alphabetical order between different ones).  Buckets are sorted one at
   a time, so a task holds one bucket (about a million suffixes), never an
   array over the corpus.
3. Equal suffixes of one bucket stand in document order; all but the first are
   repeats.  The answers go back to the blocks, which cut the bytes.

Suffixes that repeat inside one block are settled there, so a passage that a
third of all documents share arrives once per block.

Edge cases: a null or empty text has no bytes; a text shorter than the window
loses nothing; rows that repeat id and text are one document; rows with one id
and different texts are ordered by text; null ids come first; an empty table
gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm import repeats as R
from termweave.llm.common import checkpoint, named_back, positional, release, tidy
from termweave.llm.rolling import Rolling, covered

U = np.uint64
WINDOW = 100
# Perfect difference sets; every residue modulo v is a difference.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16),
          31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves samples at least two fifths of the window."""
    v = max(v for v in COVERS if v == 1 or 5 * (window - v + 1) >= 2 * window)
    return v, COVERS[v]


class Block:
    """The bytes and cover samples of one block."""

    def __init__(self, payload: bytes, i: int, t: int, window: int):
        self.table, self.texts, self.owner = R.block_rows(payload, i, t)
        self.window = window
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        buf = np.frombuffer(b"".join(self.texts), np.uint8)
        self.rolling = Rolling.of_bytes(buf)
        self.v, cover = cover_for(window)
        short = window - self.v + 1
        table = np.zeros(self.v, bool)
        table[list(cover)] = True
        at = [np.flatnonzero(np.resize(table, max(0, n - short + 1))) + lo
              for lo, n in zip(self.first, self.size)]
        self.sample = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.keys, self.inverse, self.times = np.unique(
            self.rolling.at(self.sample, short), return_inverse=True, return_counts=True)
        self.whole, self.whole_at, self.whole_inverse = np.unique(
            R.text_keys(self.texts), return_index=True, return_inverse=True)

    def settle(self, answers: list[dict], bits: int) -> None:
        """Copies of an earlier text; the places whose window can repeat; of
        these the first of each window, sorted by hash."""
        n = int(self.size.sum())
        earlier = R.bits_of(answers, 1, "earlier", self.whole, bits)
        self.copy = earlier[self.whole_inverse]
        self.copy |= self.whole_at[self.whole_inverse] < np.arange(len(self.texts))
        again = ((self.times > 1) | R.bits_of(answers, 0, "other", self.keys, bits))[self.inverse]
        # a window sees the samples in its first v places
        near = np.zeros(n + 1, np.int32)
        p = self.sample[again]
        np.add.at(near, np.maximum(p - self.v + 1, 0), 1)
        np.add.at(near, p + 1, -1)
        fits = np.zeros(n + 1, np.int8)
        whole = (self.size >= self.window) & ~self.copy
        np.add.at(fits, self.first[whole], 1)
        np.add.at(fits, self.first[whole] + self.size[whole] - self.window + 1, -1)
        self.place = np.flatnonzero((np.cumsum(near[:n]) > 0) & (np.cumsum(fits[:n]) > 0))
        self.hashes, head, self.back = np.unique(
            self.rolling.at(self.place, self.window), return_index=True, return_inverse=True)
        self.later = np.ones(len(self.place), bool)
        self.later[head] = False


def _samples(blocks: DataFrame, i: int, t: int, window: int, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["payload"], i, t, window)
                yield R.key_rows([*R.pack_keys(0, row["block"], b.keys, bits, 4),
                                  *R.pack_keys(1, row["block"], b.whole, bits, 8)])
        tidy()

    return blocks.mapInArrow(run, R.KEYS_SCHEMA)


def dedup_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW, as_text: bool = False) -> DataFrame:
    """Append ``kept`` (binary: the remaining bytes), ``n_bytes``, ``n_removed`` and
    ``n_spans`` (maximal removed runs) to every row.  ``as_text``: ``kept`` is a
    string without the rest of a character that was cut, and null for null."""
    spark = df.sparkSession
    i, t = df.columns.index(id_col), df.columns.index(text_col)
    blocks = R.ordered_blocks(df, id_col, text_col)
    release(spark)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    v, cover = cover_for(window)
    bits = R.bucket_bits(total * len(cover) // v)
    full_bits = R.bucket_bits(total // 4)
    full_width = (64 - full_bits + 7) // 8
    kept_type = pa.string() if as_text else pa.binary()
    seen = checkpoint(R.shared_keys(_samples(blocks, i, t, window, bits), {0: 4, 1: 8}))
    release(spark)

    def send(block: int, payload: bytes, answers: list[dict]) -> pa.Table:
        b = Block(payload, i, t, window)
        b.settle(answers, bits)
        return pa.Table.from_batches([R.key_rows([*R.pack_keys(2, block, b.hashes, full_bits, full_width)])])

    judged = checkpoint(R.shared_keys(R.answer(blocks, seen, send, R.KEYS_SCHEMA), {2: full_width}))
    release(spark)

    def finish(block: int, payload: bytes, answers: list[dict]) -> pa.Table:
        b = Block(payload, i, t, window)
        b.settle(answers, bits)
        gone = b.later | R.bits_of(answers, 2, "earlier", b.hashes, full_bits)[b.back]
        removed = covered(b.place[gone], window, int(b.size.sum()))
        kept, n_removed, n_spans = [], [], []
        for k, text in enumerate(b.texts):
            cut = removed[b.first[k]:b.first[k] + b.size[k]]
            if b.copy[k] and len(text) >= window:
                cut = np.ones(len(text), bool)
            r = int(cut.sum())
            n_removed.append(r)
            n_spans.append(int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1)) if r else 0)
            kept.append(np.frombuffer(text, np.uint8)[~cut].tobytes() if r else text)
        out = b.table
        whole = pa.array([x.decode("utf-8", "ignore") for x in kept] if as_text else kept, kept_type)
        for name, values in (("r_kept", whole),
                             ("r_n_bytes", pa.array(b.size, pa.int64())),
                             ("r_n_removed", pa.array(n_removed, pa.int64())),
                             ("r_n_spans", pa.array(n_spans, pa.int64()))):
            out = out.append_column(name, values.take(pa.array(b.owner)))
        return out

    schema = T.StructType(positional(df).schema.fields + T.StructType.fromDDL(
        f"r_kept {'string' if as_text else 'binary'}, r_n_bytes long, r_n_removed long, r_n_spans long").fields)
    done = R.answer(blocks, seen.unionByName(judged), finish, schema)
    if as_text:
        done = done.withColumn("r_kept", F.when(F.col(f"c{t}").isNotNull(), F.col("r_kept")))
    return named_back(done, df.columns, ["kept", "n_bytes", "n_removed", "n_spans"])
