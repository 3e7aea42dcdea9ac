r"""Operator 5: benchmark decontamination by size-partitioned MinHash containment.

An item is found in a document when at least ``threshold`` of the item's distinct
5-word shingles stand in it.  Documents may be thousands of times longer than
an item, so the search is by containment, not by resemblance: items are
partitioned by their number of shingles n, and the size fixes the length of an
item's MinHash sketch, its ``n - ceil(threshold * n) + 1`` smallest shingle
hashes.  A document that lacks all of them lacks too many shingles to contain
the item, so probing the sketches finds every match; candidates are verified on
the shingles' words.

Everything is DataFrame expressions.  One pass over the documents probes the
sketches; the pairs found are few and select the documents to verify.  A small
side is broadcast only after counting its rows, otherwise it is shuffled.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased, so case and
punctuation do not hide an item.  Edge cases: items of fewer than five words
have no shingle and are not searched; null and empty texts match nothing;
repeated documents or items give one row for each distinct (id, text); null ids
are kept as ids; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import checkpoint

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE, THRESHOLD = 5, 0.8
# Rows of two or three longs that may be broadcast (at most some 25 MB).
BROADCAST_ROWS = 500_000


def _if_small(df: DataFrame) -> DataFrame:
    """The side to send: broadcast when its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _words(text: str) -> F.Column:
    return F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"({WORD})"), 1)


def _each_shingle(df: DataFrame, make, out: str, k: int) -> DataFrame:
    """Explode ``make(first word's position)`` over the shingles of ``words``."""
    n = F.size("words")
    places = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1)))
    return df.withColumn(out, F.explode(F.transform(places, make)))


def _hash(k: int):
    return lambda i: F.xxhash64(*[F.element_at("words", i + j) for j in range(k)])


def _line(k: int):
    return lambda i: F.array_join(F.slice("words", i, k), " ")


def _keyed(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(df[id_col].alias(name), df[text_col].alias("text")).withColumn(
        f"{name}_key", F.xxhash64(name, "text"))


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
               item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
               threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, doc_key, n_shared, n_shingles, containment)`` for every
    document that contains an item; ``doc_key`` is ``xxhash64(id, text)``."""
    d = _keyed(docs, doc_id, doc_text, "doc_id")
    wanted = (_keyed(items, item_id, item_text, "item_id").distinct()
              .withColumn("words", _words("text")).drop("text"))
    lines = _each_shingle(wanted, _line(shingle), "line", shingle).select(
        "item_id", "item_id_key", "line").distinct()
    hashed = _each_shingle(wanted, _hash(shingle), "h", shingle).select("item_id_key", "h").distinct()
    # the size of an item sets the length of its sketch
    sized = hashed.groupBy("item_id_key").agg(F.array_sort(F.collect_list("h")).alias("hashes"))
    n = F.size("hashes")
    sketch = checkpoint(sized.select("item_id_key", F.explode(F.slice(
        "hashes", F.lit(1), n - F.ceil(F.lit(threshold) * n).cast("int") + 1)).alias("h")))

    probes = _each_shingle(d.withColumn("words", _words("text")).drop("text"), _hash(shingle), "h", shingle)
    met = checkpoint(probes.select("doc_id_key", "h").join(_if_small(sketch), "h")
                     .select("doc_id_key", "item_id_key").distinct())

    suspects = _if_small(met.select("doc_id_key").distinct())
    texts = d.join(suspects, "doc_id_key", "left_semi").distinct()
    own = _each_shingle(texts.withColumn("words", _words("text")).drop("text"), _line(shingle), "line", shingle)
    shared = (own.select("doc_id", "doc_id_key", "line").distinct()
              .join(lines, "line").join(met, ["doc_id_key", "item_id_key"])
              .groupBy("doc_id", "doc_id_key", "item_id", "item_id_key").agg(F.count("*").alias("n_shared")))
    sizes = lines.groupBy("item_id_key").agg(F.count("*").alias("n_shingles"))
    return (shared.join(sizes, "item_id_key")
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
            .filter(F.col("containment") >= threshold)
            .select("doc_id", "item_id", F.col("doc_id_key").alias("doc_key"), "n_shared", "n_shingles",
                    "containment"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  **how) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns unchanged."""
    found = checkpoint(find_items(docs, items, doc_id, doc_text, **how).select("doc_key").distinct())
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = F.xxhash64(f"c{names.index(doc_id)}", f"c{names.index(doc_text)}")
    return (flat.withColumn("k", key).join(_if_small(found), F.col("k") == F.col("doc_key"), "left_anti")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))
