"""Operator 12: importance resampling towards a target distribution of hashed n-grams.

A feature is a run of one to ``max_words`` consecutive words, joined by one space;
its bucket is the unsigned CRC-32 of its UTF-8 bytes modulo ``buckets``.  A
bucket's gain compares its share of the target's features with its share of all
documents' (both smoothed by one); a document's weight is the floored mean of the
gains of its features, and Gumbel noise from a hash of its id turns the highest
scores into a draw without replacement.

Buckets are computed by length-bucketed CRC matrices: the distinct features of a
batch of documents are grouped by their length in bytes, each group is one
two-dimensional uint8 array, all its CRCs are updated column by column, and the
buckets are scattered back to the places where the features stand.

Steps: one pass over the texts stores every document's buckets (two bytes a
feature, checkpointed); the counts of each bucket are summed in Spark and the
``buckets`` gains, whose number is a parameter, come to the driver; the weights
are read off the stored buckets; ranks are counted by score, in slices
(``sources.ordinals``), never in one window over all documents.

Memory of a task: the distinct features of some ``BATCH_BYTES`` of text; longer texts
are taken in segments of whole words that overlap by ``max_words - 1`` words.

Edge cases: a null or empty text has no features and weight 0; a null id is hashed
as the empty id and comes first among equal scores; repeated rows are documents
of their own (equal ids and scores are ranked in any order); an empty table
gives an empty result, an empty target counts as no features; the text column is
left out, every other column is kept, but one named like an added column gives
way to it.  Building the plan runs jobs (the checkpoints and the bucket sums).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.ascii_words import utf8, word_lists
from termweave.llm.common import checkpoint, named_back, positional, ship_package
from termweave.sources.ordinals import counts_before

BATCH_BYTES = 1 << 20
# A matrix row of a feature longer than this would be walked for few features: they
# are hashed one by one, to the same value.
LONG_FEATURE = 4_096
POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return crc


CRC_TABLE = _table()


def crc_matrices(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices ``text[start:start + length]``: one matrix for each
    length, all its CRCs updated column by column."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    heads = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for lo, hi in zip(heads, [*heads[1:], len(order)]):
        rows, length = order[lo:hi], int(lengths[order[lo]])
        if length > LONG_FEATURE:
            for r in rows:
                out[r] = zlib.crc32(text[starts[r]:starts[r] + length])
            continue
        matrix = text[starts[rows][None, :] + np.arange(length)[:, None]]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = CRC_TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def feature_buckets(lists: list[list[bytes]], owner: list[int], fresh: list[int], max_words: int,
                    buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``max_words`` words: the owner of each run and its bucket.
    ``lists`` are consecutive words, each list with its ``owner``; a run whose last
    word is among the first ``fresh`` words of its list was counted before."""
    words = [w for x in lists for w in x]
    if not words:
        return []
    sizes = np.array([len(x) for x in lists])
    text = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    of = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new = place >= np.asarray(fresh)[of]
    codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    distinct = int(codes.max()) + 1
    grams, out = codes, []
    for n in range(1, max_words + 1):
        if n > 1:  # the run of n - 1 words that starts here and the word after it
            m = max(0, len(words) - n + 1)
            grams = grams[:m] * distinct + codes[n - 1:]
        whole = np.flatnonzero(of[:len(grams)] == of[n - 1:])
        keys, first, back = np.unique(grams[whole], return_index=True, return_inverse=True)
        at = whole[first]
        crc = crc_matrices(text, starts[at], starts[at + n - 1] + lengths[at + n - 1] - starts[at])
        counted = new[whole + n - 1]
        out.append((np.asarray(owner)[of[whole]][counted], (crc % np.uint32(buckets))[back][counted]))
        if n < max_words:  # numbers of the runs, so that products stay small
            grams = np.zeros(len(grams), np.int64)
            grams[whole] = back
    return out


def with_features(df: DataFrame, text_col: str, max_words: int, buckets: int) -> DataFrame:
    """Every row by position without its text, with ``n_words``, ``n_features`` and
    ``buckets`` (packed: two bytes a feature, four above 65,536 buckets)."""
    ship_package(df.sparkSession)
    base = positional(df)
    at = df.columns.index(text_col)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    kept = [f for k, f in enumerate(base.schema.fields) if k != at]
    schema = T.StructType(kept + T.StructType.fromDDL("n_words long, n_features long, buckets binary").fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(at))
            others = [c for k, c in enumerate(batch.columns) if k != at]
            done, n_words = 0, [0] * len(texts)
            packed: list[list[bytes]] = [[] for _ in texts]
            lists, owner, fresh, size = [], [], [], 0

            def flush():
                nonlocal lists, owner, fresh, size
                for who, which in feature_buckets(lists, owner, fresh, max_words, buckets):
                    which = which.astype(kind)
                    cuts = np.flatnonzero(np.diff(who, prepend=-1))
                    for lo, hi in zip(cuts, [*cuts[1:], len(who)]):
                        packed[who[lo]].append(which[lo:hi].tobytes())
                lists, owner, fresh, size = [], [], [], 0

            def rows(lo, hi):
                blobs = [b"".join(x) for x in packed[lo:hi]]
                for k in range(lo, hi):
                    packed[k] = []
                width = np.dtype(kind).itemsize
                return pa.RecordBatch.from_arrays(
                    [*[c.slice(lo, hi - lo) for c in others], pa.array(n_words[lo:hi], pa.int64()),
                     pa.array([len(b) // width for b in blobs], pa.int64()), pa.array(blobs, pa.binary())], names=names)

            for k, text in enumerate(texts):
                tail: list[bytes] = []
                for part in word_lists(text):
                    n_words[k] += len(part)
                    lists.append([*tail, *part])
                    owner.append(k)
                    fresh.append(len(tail))
                    tail = lists[-1][len(lists[-1]) - max_words + 1:] if max_words > 1 else []
                    size += sum(map(len, part)) + len(part)
                    if size >= BATCH_BYTES:
                        flush()
                if not size and k - done >= 255:  # all rows so far are whole
                    yield rows(done, k + 1)
                    done = k + 1
            flush()
            if done < len(texts):
                yield rows(done, len(texts))

    return base.mapInArrow(run, schema)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket: summed per task, then in Spark; the
    ``buckets`` sums come to the driver."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())],
                                         names=["bucket", "n"])

    summed = features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares, by bucket."""
    n, total_s, total_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (total_s + n) / ((float(s) + 1) * (total_t + n))))
                     for s, t in zip(source, target)], np.int64)


def with_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``weight`` (floored mean gain, 0 without features) in place of ``buckets``."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    shared = features.sparkSession.sparkContext.broadcast(gain)
    fields = features.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            weight = [int(table[x].sum()) // len(x) if len(x) else 0 for x in
                      (np.frombuffer(blob.as_buffer(), kind) for blob in batch.columns[-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())],
                                             names=[*batch.schema.names[:-1], "weight"])

    return features.mapInArrow(run, T.StructType(fields + [T.StructField("weight", T.LongType())]))


def noise(id_col: str, seed: int) -> F.Column:
    """Floored thousandths of Gumbel noise from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, id_col: str, eligible: F.Column, percent: int) -> DataFrame:
    """Add ``rank``: 1, 2, 3, ... by falling ``score``, then id, for the floored
    ``percent`` of the eligible rows; null for the others.

    Gumbel noise spreads even equal texts over the scores, so a window over the
    rows of one score is small; the rows before a score are counted in slices.
    ``scored`` is read three times and must be stored."""
    live = scored.withColumn("_live", eligible)
    fall = live.filter("_live").withColumn("_fall", -F.col("score"))
    before = counts_before(fall.groupBy("_fall").agg(F.count(F.lit(1)).alias("_n")), [], "_fall", "_n", "_before",
                           bits=8, width=32).drop("_n")
    number = F.row_number().over(Window.partitionBy("_fall").orderBy(F.col(id_col).asc_nulls_first()))
    size = fall.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    place = F.col("_before") + F.col("_number")
    ranked = fall.withColumn("_number", number).join(before, "_fall").withColumn(
        "rank", F.when(place <= percent * size // 100, place)).drop("_fall", "_before", "_number")
    rest = live.filter(~F.col("_live")).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_live")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", max_words: int = 2, buckets: int = 10_000, min_words: int = 20,
             percent: int = 25, seed: int = 7) -> DataFrame:
    """Every row without its text, with ``n_features``, ``weight``, ``score`` and
    ``rank``: ``percent`` of the rows with at least ``min_words`` words are drawn
    (rank from 1), the others have a null rank."""
    at = df.columns.index(text_col)
    kept = [n for k, n in enumerate(df.columns) if k != at]
    features = checkpoint(with_features(df, text_col, max_words, buckets))
    wanted = with_features(target.select(target_col), target_col, max_words, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    place = f"c{df.columns.index(id_col)}"
    weighed = with_weights(features, gain)
    scored = checkpoint(weighed.withColumn("score", F.col("weight") + noise(place, seed)))
    out = draw(scored, place, F.col("n_words") >= min_words, percent)
    first = [f"c{k}" for k in range(len(df.columns)) if k != at]
    added = ["n_features", "weight", "score", "rank"]
    return named_back(out.select(*first, *added).toDF(*[f"c{j}" for j in range(len(kept))], *[f"r_{a}" for a in added]),
                      kept, added)
