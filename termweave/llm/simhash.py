r"""Operator 8: SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit set where more than half of the shingle hashes (XXH64,
seed 42, of the words joined by one space) have it.  Two fingerprints link when
at most ``max_bits`` (up to 3) bits differ.

Every distinct fingerprint emits the variants within half of that distance,
and two that link emit a common variant.  For 3 bits one side of a pair goes
one step and the other two: linked fingerprints at an odd distance differ in
parity, so those of even parity emit all variants within 1 bit, those of odd
parity also flip two bits.  Of any three differing bits two lie in one half of
the word, so only pairs inside a half are flipped: 65 or 1,057 variants.

Variants are matched in two steps: ``repeats.shared_keys`` finds the variants
that two fingerprints emit (three to four bytes each, delta-coded), then only
these travel as rows.  All who meet at a variant within half the distance link
to the smallest of them, and so do those one step further out; the links are
verified, and no pairs of a group are listed.  Components are labelled by
alternating large and small stars, a checkpoint after each round.

Edge cases: null and empty texts have fingerprint 0 and link like any other;
fewer words than a shingle make one shingle of the whole sequence; repeated
rows share fingerprint and component; null ids are never the smallest unless a
component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm import repeats as R
from termweave.llm.common import checkpoint, map_texts, release, shuffle_partitions, tidy

U = np.uint64
SEED = 42
FINGERPRINTS_PER_BLOCK = 1024  # half a million variants on average


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space
    if not words:
        return 0
    line, ends = b" ".join(words), list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        hashes = [digest(line[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    n = len(hashes)
    padded = np.zeros((n + 127) // 128 * 128, "<u8")
    padded[:n] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def add_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Append ``fingerprint`` (long: the 64 bits, signed)."""

    def make():
        def apply(texts):
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], U).view(np.int64))]
        return apply

    return map_texts(df, text_col, "fingerprint long", make)


def _flips(max_bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Masks to flip for even and odd parity, and for how many of them, in
    order, a variant lies within ``max_bits // 2``."""
    one = [1 << b for b in range(64)]
    two = [x | y for half in (one[:32], one[32:]) for x, y in itertools.combinations(half, 2)]
    near = [0] + (one if max_bits >= 2 else [])
    odd = near + (one if max_bits == 1 else []) + (two if max_bits == 3 else [])
    return [np.array(near, U), np.array(odd, U)], len(near)


def _variants(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variant, number of its fingerprint, whether it is within half the distance."""
    flips, near = _flips(max_bits)
    odd = np.bitwise_count(fps).astype(bool) & (np.bitwise_count(fps) % 2 == 1)
    out = []
    for flip, who in zip(flips, (np.flatnonzero(~odd), np.flatnonzero(odd))):
        out.append(((fps[who][:, None] ^ flip).reshape(-1), np.repeat(who, len(flip)),
                    np.tile(np.arange(len(flip)) < near, len(who))))
    return tuple(np.concatenate(x) for x in zip(*out))


def links(fingerprints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(a, b)`` links, a > b, between the distinct values of column
    ``fingerprint`` that connect everything within ``max_bits``; a link joins
    two fingerprints that really are so close, but not all such pairs are listed."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits is 0 to 3")

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), FINGERPRINTS_PER_BLOCK):
                part = fps[lo:lo + FINGERPRINTS_PER_BLOCK]
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()),
                                                  "n": pa.array([len(part)], pa.int64()),
                                                  "payload": pa.array([part.tobytes()], pa.binary())})
                number += 1

    # by another expression than the grouping's, or the planner drops the exchange
    spread = fingerprints.select("fingerprint").repartition(
        shuffle_partitions(fingerprints.sparkSession), F.xxhash64("fingerprint"))
    blocks = checkpoint(spread.mapInArrow(pack, "block long, n long, payload binary"))
    n = blocks.agg(F.sum("n")).first()[0] or 0
    flips, _ = _flips(max_bits)
    bits = R.bucket_bits(n * (len(flips[0]) + len(flips[1])) // 2)

    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.unique(_variants(np.frombuffer(row["payload"], U), max_bits)[0])
                yield R.key_rows([*R.pack_keys(0, row["block"], keys, bits, 4)])
        tidy()

    met = R.shared_keys(blocks.mapInArrow(emit, R.KEYS_SCHEMA), {0: 4})

    def meeting(block: int, payload: bytes, answers: list[dict]) -> pa.Table:
        fps = np.frombuffer(payload, U)
        variants, who, near = _variants(fps, max_bits)
        keys, inverse, times = np.unique(variants, return_inverse=True, return_counts=True)
        hit = ((times > 1) | R.bits_of(answers, 0, "other", keys, bits))[inverse]
        return pa.table({"variant": pa.array(variants[hit].view(np.int64)),
                         "fingerprint": pa.array(fps[who[hit]].view(np.int64)),
                         "near": pa.array(near[hit])})

    # met is small beside the variants; the meeting rows are used twice
    meetings = checkpoint(R.answer(blocks, met, meeting, "variant long, fingerprint long, near boolean"))
    release(fingerprints.sparkSession)
    centre = (meetings.filter("near").groupBy("variant").agg(F.min("fingerprint").alias("centre")))
    pair = meetings.join(centre, "variant").filter(F.col("fingerprint") != F.col("centre"))
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("centre"))) <= max_bits
    return (pair.filter(close)
            .select(F.greatest("fingerprint", "centre").alias("a"), F.least("fingerprint", "centre").alias("b"))
            .distinct())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is the
    smallest node of the component."""
    edges = checkpoint(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.join(low, "a").filter(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("low").alias("b")))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").filter(F.col("b") != F.col("low"))
                 .select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(low.withColumnRenamed("low", "b")))
        edges = checkpoint(small.distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``df``: ``(doc_id, fingerprint long, text_key, component_id)``."""
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    marked = checkpoint(add_fingerprint(rows, "text", shingle).select(
        "doc_id", "fingerprint", F.xxhash64("text").alias("text_key")))
    groups = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    label = components(links(groups, max_bits))
    rooted = groups.join(label, groups["fingerprint"] == label["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = rooted.join(ids, "root").select("fingerprint", "component_id")
    return marked.join(of, "fingerprint").select("doc_id", "fingerprint", "text_key", "component_id")


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component the document
    with the smallest id stays (of repeated rows, one)."""
    judged = near_duplicates(df, id_col, text_col, shingle, max_bits)
    rows = judged.groupBy("doc_id", "text_key", "fingerprint", "component_id").agg(F.count(F.lit(1)).alias("copies"))
    # null ids order last; a component without ids is told by its fingerprint
    first = checkpoint(
        rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
        .agg(F.min(F.struct("fingerprint", "text_key", "copies")).alias("s"))
        .select(F.col("component_id").alias("k_id"), F.col("s.text_key").alias("k_text"),
                F.col("s.copies").alias("k_copies")))
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    row_id, row_text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    flat = flat.withColumn("k_key", F.xxhash64(row_text))

    def having(firsts: DataFrame) -> DataFrame:
        return flat.join(firsts, F.col(row_id).eqNullSafe(F.col("k_id")) & (F.col("k_key") == F.col("k_text")))

    # only rows that stand in the table more than once, if any, are grouped with their texts
    kept, repeated = having(first.filter("k_copies = 1")), first.filter("k_copies > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(having(repeated).dropDuplicates([row_id, "k_key"]))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
