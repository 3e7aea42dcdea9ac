"""Operators 11, 12 and 13 against plain Python and the library, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import ascii_words, queries, ranked_search, resampling, token_counts

WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
EDGE = [None, "", " ", "  ", "a", "a  b   c ", "\n\t x\r\n", "▁a▁ ▁", "<s>a</s> <unk>", "漢字かな 🙂🙂é ÉÀ", "x" * 5000,
        "word " * 3000, "end.\nBegin\x00\x1fz", "A-B_C 12½", "ab cd ef"]


def words(text):
    return WORDS.findall((text or "").translate(UPPER))


def texts(seed, n=60):
    rng = random.Random(seed)
    stock = ["the", "of", "Alpha", "beta", "Été", "x1", "gamma-ray", "漢字", "delta", "of the"]
    out = [" ".join(rng.choice(stock) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(0, 40)))
           for _ in range(n)]
    return [*EDGE, *out, *out[:5]]


def clashing(spark, values):
    """Repeated rows and ids, null ids, columns named like results."""
    rows = [(k // 2 if k % 7 else None, t, "x", 7, -1, 2.5) for k, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens int, rank int, c0 double")


def test_word_lists_cut_nothing(monkeypatch):
    monkeypatch.setattr(ascii_words, "SEGMENT_BYTES", 7)
    for t in texts(1):
        raw = (t or "").encode()
        assert [w.decode() for part in ascii_words.word_lists(raw) for w in part] == words(t)


# ---------------------------------------------------------------- 13

@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=queries.vocabulary_path(queries.PIECE_BPE))


@pytest.mark.parametrize("block,segment", [(8_000_000, 1 << 20), (40, 1 << 20), (400, 5)])
def test_token_counts_are_the_librarys(spark, monkeypatch, pieces, block, segment):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_counts, "SEGMENT_CHARS", segment)
    rng = random.Random(3)
    alphabet = "aabcdeehilmnorst   \n\t▁éß漢🙂0123.,-'\"<>/s\x00 "
    values = texts(2) + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = clashing(spark, values).repartition(3)
    out = token_counts.count_tokens(df, queries.vocabulary_path(queries.PIECE_BPE))
    assert out.columns == ["doc_id", "kept", "rank", "c0", "n_bytes", "n_tokens"]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in df.collect())


def test_every_pre_token_is_counted_once(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_BYTES", 100)
    df = spark.createDataFrame([(k, "one two two three") for k in range(50)], "doc_id long, text string").repartition(4)
    model = token_counts.PieceModel(queries.vocabulary_path(queries.PIECE_BPE))
    blocks = token_counts.pre_token_blocks(df, "text", model.pattern)
    assert blocks.count() > 4
    words = token_counts.dealt_words(blocks, 3)
    seen = Counter(w for r in words.collect() for w in token_counts.open_words(r.n, r.size, r.words))
    assert seen == dict.fromkeys([b" one", b" two", b" three"], blocks.count())
    # all rows of a bucket come from one task, one after the other
    found = token_counts.count_pieces(words, model).withColumn("part", F.spark_partition_id()).collect()
    assert sum(r.n for r in found) == 3 * blocks.count()
    assert len({(r.bucket, r.part) for r in found}) == len({r.bucket for r in found})


def test_packed_words_come_back():
    for words in ([], [b""], ["é", "", "a\0b", "x" * 300]):
        words = [w if isinstance(w, bytes) else w.encode() for w in words]
        assert token_counts.open_words(*token_counts.pack_words(words)) == words


def test_token_counts_of_an_empty_table_and_the_query(spark, sf_dir, pieces):
    path = queries.vocabulary_path(queries.PIECE_BPE)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(given)
    for r in rows:
        n = len(pieces.encode(given[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(given[r.doc_id].encode()), n, n > 4096)


# ---------------------------------------------------------------- 12

def test_crc_matrices_equal_zlib(monkeypatch):
    monkeypatch.setattr(resampling, "LONG_FEATURE", 30)
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 700)
    lengths = rng.integers(0, 60, 700)
    want = [zlib.crc32(text[a:a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert resampling.crc_matrices(text, starts, lengths).tolist() == want


def py_resample(rows, target, max_words, buckets, min_words, percent, seed):
    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets
                for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text))
    for text in target:
        t.update(grams(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out, live = [], []
    for k, (i, text) in enumerate(rows):
        g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(g), weight, score))
        if len(words(text)) >= min_words:
            live.append((-score, i is not None, i or 0, k))
    rank = {k: n for n, (*_, k) in enumerate(sorted(live), 1) if n <= percent * len(live) // 100}
    return [(*row, rank.get(k)) for k, row in enumerate(out)]


@pytest.mark.parametrize("max_words,batch,segment", [(2, 1 << 20, 1 << 20), (2, 60, 9), (3, 200, 30), (1, 10, 5)])
def test_resampling_against_brute_force(spark, monkeypatch, max_words, batch, segment):
    monkeypatch.setattr(resampling, "BATCH_BYTES", batch)
    monkeypatch.setattr(ascii_words, "SEGMENT_BYTES", segment)
    rows = [(k, t) for k, t in enumerate(texts(5))]
    rows[3] = (None, rows[30][1])
    target = ["alpha beta gamma of the", None, "", "x1 漢字 x1 漢字"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, wanted, max_words=max_words, buckets=97, min_words=5, percent=40, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = py_resample(rows, target, max_words, 97, 5, 40, 7)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_resampling_of_empty_tables_and_equal_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    same = spark.createDataFrame([(5, "a b c")] * 10, "doc_id long, text string")
    rows = resampling.resample(same, none, min_words=3, percent=50).collect()
    assert len({r.score for r in rows}) == 1
    assert sorted(r.rank for r in rows if r.rank) == [1, 2, 3, 4, 5]


# ---------------------------------------------------------------- 11

def py_search(rows, items, k):
    docs = [(i, Counter(words(t))) for i, t in rows if words(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, terms in items.items():
        found = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("k,block,cells", [(5, 4096, 1 << 21), (3, 2, 40), (200, 3, 1)])
def test_search_against_brute_force(spark, monkeypatch, k, block, cells):
    monkeypatch.setattr(ranked_search, "ITEM_BLOCK", block)
    monkeypatch.setattr(ranked_search, "MATRIX_CELLS", cells)
    rows = [(j, t) for j, t in enumerate(texts(9))]
    rows[20] = (None, rows[21][1])
    given = [(1, "the alpha of BETA"), (2, "alpha beta gamma"), (3, "Été x1 the"), (4, ""), (5, None), (6, "nowhere"),
             (7, "alpha beta gamma the"), (7, "漢字"), (None, "delta of")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    items = spark.createDataFrame(given, "item_id int, text string")
    pooled = {}
    for i, t in given:
        pooled.setdefault(i, set()).update(words(t))
    got = Counter(map(tuple, ranked_search.search(df, items, k=k).collect()))
    assert got == Counter(py_search(rows, pooled, k))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(none, items).collect() == []
    out = ranked_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0))
    assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_sharing_plan_makes_each_shared_sum_once():
    rng = random.Random(8)
    terms = [f"t{k}".encode() for k in range(40)]
    items = {k: set(rng.sample(terms[:10 + k], rng.randint(0, 12))) for k in range(30)}
    items[100] = items[101] = set(terms[:9])
    plan = ranked_search.sharing_plan(items)
    made, parts, serves = {}, {}, Counter()
    for t, n in plan.terms.items():
        made.setdefault(int(plan.class_of[n]), set()).add(t)
    for level in plan.levels:
        for node, a, b in zip(*level):
            assert not made[a] & made[b]
            made[node], parts[node] = made[a] | made[b], (a, b)
    assert len(made) == plan.nodes
    assert len({frozenset(x) for x in made.values()}) == len(made)  # no set is made twice
    for k, item in enumerate(plan.items):
        nodes = plan.item_nodes[plan.item_cuts[k]:plan.item_cuts[k + 1]]
        assert set().union(*[made[n] for n in nodes]) == items[item]
        assert sum(len(made[n]) for n in nodes) == len(items[item])
        below = nodes.tolist()
        for n in below:
            below.extend(parts.get(n, ()))
        serves.update(below)
    # every sum of two nodes serves at least two items
    assert parts and all(serves[node] > 1 for node in parts)
    doc, term = np.array([0, 0, 2]), np.array([0, 3, 3])
    sums = ranked_search.accumulators(plan, doc, term, np.array([5, 7, 11]), 3)
    first, fourth = sorted(plan.terms)[0], sorted(plan.terms)[3]
    for k, item in enumerate(plan.items):
        has = (first in items[item]) * 5, (fourth in items[item])
        assert sums[k].tolist() == [has[0] + 7 * has[1], 0, 11 * has[1]]
