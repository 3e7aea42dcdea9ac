"""Corpus pipeline: five training-data operators, one after the other.

Each stage takes all documents its predecessor kept.  All but the last return
the columns of the documents, whatever else these are called; stages work on
columns by position, so extra columns cannot clash with an operator's own.

Null and empty texts fail the quality rules.  Repeated rows and ties are settled
by the operators as their docstrings say; empty tables pass through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, decontaminate, rules, simhash, suffix
from termweave.llm.common import checkpoint
from termweave.llm.queries import vocabulary_path


def _flat(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with columns p0, p1, ... and the names of id and text."""
    names = docs.columns
    return (docs.toDF(*[f"p{i}" for i in range(len(names))]),
            f"p{names.index('doc_id')}", f"p{names.index('text')}")


def _named(out: DataFrame, docs: DataFrame, **changed: F.Column) -> DataFrame:
    return out.select(*[changed.get(n, F.col(f"p{i}")).alias(n) for i, n in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that a rule rejects go."""
    flat, _, text = _flat(docs)
    return _named(rules.cascade(flat, text).filter("kept"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates one document stays."""
    flat, doc_id, text = _flat(docs)
    return _named(simhash.one_of_each_group(flat, doc_id, text, shingle=3, max_bits=3), docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: repeated strings of 100 bytes are cut out of the texts (with
    what is left of a character they divide); documents stay."""
    flat, doc_id, text = _flat(docs)
    out = suffix.dedup_bytes(flat, doc_id, text, window=100, as_text=True)
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return _named(out, docs, **changed)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that contain a benchmark item go."""
    flat, doc_id, text = _flat(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _named(decontaminate.decontaminate(flat, items, doc_id, text), docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids of every text, and the digest of what they decode to."""
    path = vocabulary_path()
    ids = bpe.encode(docs.select("doc_id", "text"), path, "text").select("doc_id", "ids")
    return bpe.decode(ids, path, "ids", "decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# Fingerprints (XXH64), byte strings and BPE are beyond DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table.  What a stage keeps is stored in the
    shared checkpoint folder before the next one reads it (several times): without
    that, each reading would run all the stages before it again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
