"""Registered queries of the training-data operators, with SQL where it can say
the same.  Each applies its operator to the whole table and derives the
contract's columns from the operator's own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, decontaminate, html_content, licenses, quality, rules
from termweave.llm import ranked_search, resampling, simhash, substring, suffix, token_counts, toxicity
from termweave.llm.common import read_table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    path = vocabulary_path()
    ids = bpe.encode(docs, path, "text").select("doc_id", "ids")
    both = bpe.decode(ids, path, "ids", "decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return substring.dedup_words(docs, window=20).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _fold(buckets: int, which: int) -> F.Column:
    """Whether crc32 of the id as text falls into one of the folds (null: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % buckets == which, F.lit(False))


def _scored(df: DataFrame, held_out: F.Column, threshold: float) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), "score",
                     F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = _fold(5, 0)
    return _scored(quality.score(docs, labels, label_col="quality", allowed=~held_out), held_out, 0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = _fold(3, 1)
    return _scored(toxicity.score(docs, labels, label_col="toxic", allowed=~held_out), held_out, 0.7)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(docs, items).select(
        "doc_id", "item_id", "n_shared", "n_shingles", "containment")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return licenses.scan(docs).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return rules.measured_cascade(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs, shingle=3, max_bits=3).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix.dedup_bytes(docs, window=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_content.extract(pages).drop("html")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search.search(docs, items, k=50)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(docs, target, max_words=2, buckets=10_000, min_words=20, percent=25, seed=7)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary_path(PIECE_BPE)).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_licenses": op6_licenses,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_html": op10_html,
    "op11_ranked_search": op11_ranked_search,
    "op12_resampling": op12_resampling,
    "op13_token_counts": op13_token_counts,
}

# Words of operators 11 and 12: only A-Z are lower-cased.
_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS seq
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k
                                FROM win) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps
         FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(list_select(words, list_filter(range(1, len(words) + 1),
              lambda p: ps IS NULL OR NOT list_contains(ps, p))), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8""",
    "op11_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf
       FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
       WHERE term IN (SELECT term FROM b) GROUP BY r, doc_id, n, term),
df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
       FROM tf, c GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf)
             // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM tf JOIN df USING (term) JOIN b USING (term), c GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
      FROM s WHERE score > 0) WHERE rank <= 50""",
    "op12_resampling": f"""
WITH crc AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
h AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i:
               ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
               lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
      FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM df) AS total_s, (SELECT count(*) FROM bf) AS total_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (total_s + 10000)
               / ((s + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
m AS (SELECT r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
      FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
               / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT x.doc_id, n_features, weight, score,
       CASE WHEN rank <= 25 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank
FROM x LEFT JOIN k USING (doc_id)""",
    "op7_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM win),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters
      FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words
            OR 2 * letters < word_chars) AS kept
FROM m""",
}
