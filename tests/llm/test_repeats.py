"""Operators on repeats (2, 8, 9, 5) against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from termweave.llm import decontaminate, queries, repeats, rolling, simhash, substring, suffix

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def cut_repeats(rows, units, window):
    """{id: (n, removed, spans, kept)} where rows ascend by (id, text)."""
    seen, out = {}, {}
    for key, text in rows:
        u = units(text)
        cut = [False] * len(u)
        for i in range(len(u) - window + 1):
            w = u[i:i + window] if isinstance(u, bytes) else tuple(u[i:i + window])
            first = seen.setdefault(w, (key, text, i))
            if first != (key, text, i):
                cut[i:i + window] = [True] * window
        spans = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out[key, text] = (len(u), sum(cut), spans, [x for x, c in zip(u, cut) if not c])
    return out


def random_rows(seed, letters, n=25):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60))) for _ in range(8)]
    rows = [(k, rng.choice(base) + rng.choice(["", rng.choice(base)])) for k in range(n)]
    return rows + [(90, None), (91, ""), (92, "a " * 50), (93, "aé" * 30), (None, base[0]), (7, base[1]), (3, rows[3][1])]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


@pytest.mark.parametrize("seed,window,gram,block", [(0, 6, 3, 60), (1, 5, 2, 400), (2, 20, 8, 4000), (3, 4, 4, 60)])
def test_substring_dedup_against_brute_force(spark, monkeypatch, seed, window, gram, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rows = random_rows(seed, "abc" if seed % 2 else "aéb")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(3)
    got = substring.dedup_words(df, window=window, gram=gram).collect()
    want = cut_repeats(ordered(rows), lambda t: SPACE_WORDS.findall(t or ""), window)
    assert len(got) == len(rows)
    for r in got:
        n, removed, _, kept = want[r.doc_id, r.text]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, " ".join(kept)), (r.doc_id, r.text)


@pytest.mark.parametrize("limit", [4, 40])
def test_substring_dedup_bounds_the_stretches_of_an_anchor(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substring, "CROWD", limit)
    sent, answer = [], repeats.answer
    monkeypatch.setattr(repeats, "answer", lambda *a: sent.append(answer(*a)) or sent[-1])
    rng = random.Random(4)
    own = [[f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randint(0, 30))] for _ in range(60)]
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([*x, *passage, *rng.choice(own)])) for k, x in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring.dedup_words(df)
    most = {}
    for r in sent[0].collect():
        for at in range(0, len(r.anchor), 8):
            most[r.anchor[at:at + 8]] = most.get(r.anchor[at:at + 8], 0) + 1
    assert max(most.values(), default=0) <= limit
    want = cut_repeats(ordered(rows), lambda t: SPACE_WORDS.findall(t or ""), 20)
    for r in out.collect():
        n, removed, _, kept = want[r.doc_id, r.text]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, " ".join(kept)), (r.doc_id, r.text)


@pytest.mark.parametrize("limit", [0, 3, 30])
def test_crowded_anchors_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 60)
    monkeypatch.setattr(substring, "CROWD", limit)
    rows = random_rows(limit, "abc")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = cut_repeats(ordered(rows), lambda t: SPACE_WORDS.findall(t or ""), 6)
    got = substring.dedup_words(df, window=6, gram=3).collect()
    assert len(got) == len(rows)
    for r in got:
        n, removed, _, kept = want[r.doc_id, r.text]
        assert (r.n_words, r.n_removed, r.kept) == (n, removed, " ".join(kept)), (r.doc_id, r.text)


def test_blocks_are_cut_inside_one_id(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    rng = random.Random(6)
    letters = "abc"
    rows = [(None, "".join(rng.choice(letters + " ") for _ in range(100))) for _ in range(100)]
    rows += [(None, rows[0][1])] * 3 + [(1, x) for _, x in rows[:50]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats.ordered_blocks(df, "doc_id", "text").agg(F.max("n_bytes")).first()[0] <= 2400
    want = cut_repeats(ordered(rows), lambda t: SPACE_WORDS.findall(t or ""), 6)
    for r in substring.dedup_words(df, window=6, gram=3).collect():
        assert (r.n_words, r.n_removed) == want[r.doc_id, r.text][:2]
    want = cut_repeats(ordered(rows), lambda t: (t or "").encode(), 9)
    for r in suffix.dedup_bytes(df, window=9).collect():
        assert (r.n_bytes, r.n_removed) == want[r.doc_id, r.text][:2]


@pytest.mark.parametrize("seed,window,block", [(0, 6, 60), (1, 9, 400), (2, 20, 4000), (3, 4, 60)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, seed, window, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rows = random_rows(seed, "abc" if seed % 2 else "aé")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(3)
    got = suffix.dedup_bytes(df, window=window).collect()
    want = cut_repeats(ordered(rows), lambda t: (t or "").encode(), window)
    assert len(got) == len(rows)
    for r in got:
        n, removed, spans, kept = want[r.doc_id, r.text]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, spans, bytes(kept))


def test_dedup_of_empty_tables_and_one_long_text(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedup_words(empty).count() == suffix.dedup_bytes(empty).count() == 0
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10 ** 6)) for _ in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id long, text string")
    assert [r.n_removed for r in substring.dedup_words(df).orderBy("doc_id").collect()] == [0, 60_000, 0]
    assert [r.n_removed for r in suffix.dedup_bytes(df).orderBy("doc_id").collect()] == [0, len(text), 0]


@pytest.mark.parametrize("window", [1, 4, 9, 20, 100])
def test_difference_cover_property(window):
    v, cover = suffix.cover_for(window)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert window - v + 1 >= 1


def thue_morse(n):
    return [bin(k).count("1") % 2 for k in range(n)]


def test_words_that_differ_everywhere_are_different(spark):
    # equal modulo 2**64 under every base: one word is the other with its letters swapped
    a, b = ("".join("ab"[x ^ flip] for x in thue_morse(2048)) for flip in (0, 1))
    same = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([*same, a])), (2, " ".join([*same, b])), (3, " ".join([*same, a, "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_words(df).collect()} == {1: 0, 2: 0, 3: 20}
    bits = np.array(thue_morse(4096), np.uint8)
    hashes = rolling.Rolling(rolling.BYTE_SYMBOLS[np.concatenate([bits, 1 - bits])]).at(np.array([0, 4096]), 4096)
    assert hashes[0] != hashes[1]


def test_rolling_hash_is_the_polynomial_modulo_the_prime(monkeypatch):
    monkeypatch.setattr(rolling, "CHUNK", 7)
    monkeypatch.setattr(rolling, "KEPT_POWERS", 1 << 13)
    rng = np.random.default_rng(4)
    for n in (0, 1, 50, 9000):
        symbols = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        r = rolling.Rolling(symbols)
        for lo, length in ((0, n), (n // 3, n // 2), (n // 2, min(3, n - n // 2))):
            want = sum(int(x) * pow(rolling.BASE, k, rolling.PRIME) for k, x in
                       enumerate(symbols[lo:lo + length])) % rolling.PRIME
            got = r.at(np.array([lo]), length)
            assert got.tolist() == rolling.mix(np.array([want], np.uint64)).tolist()
        text = rng.integers(0, 256, n).astype(np.uint8)
        same = rolling.Rolling(text.astype(np.uint64) + np.uint64(1))
        assert rolling.Rolling.of_bytes(text).sums.tolist() == same.sums.tolist()


def test_rolling_hash_tells_windows_apart():
    import numpy as np
    text = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    r = rolling.Rolling(rolling.BYTE_SYMBOLS[text])
    h = r.every(5)
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (text[i:i + 5].tobytes() == text[j:j + 5].tobytes())
    assert (r.at(np.arange(3), np.full(3, 5)) == h[:3]).all()


def test_suffix_automaton_matching_statistics():
    rng = random.Random(8)
    for _ in range(60):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(4, 14))] for _ in range(4)]
        bases = rng.sample(range(0, 1000, 20), 4)
        auto = substring.SuffixAutomaton()
        for s, b in zip(seqs, bases):
            auto.add(s, b)
        auto.close()
        for s in seqs:
            want = [min(b + j + 3 for t, b in zip(seqs, bases) for j in range(len(t) - 3) if t[j:j + 4] == s[i:i + 4])
                    for i in range(len(s) - 3)]
            assert auto.earliest(s, 4) == want


def slow_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [words] if len(words) < k else [words[i:i + k] for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, bits):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_simhash_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(200)] for _ in range(12)]
    rows = []
    for k in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((k, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    rows += [(200, None), (201, ""), (202, "É one"), (203, "É one"), (204, "a b c"), (5, rows[5][1]), (None, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(fps, 3)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), signed(f), least[g]) for (i, _), f, g in zip(rows, fps, group))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.one_of_each_group(df.withColumn("fingerprint", F.lit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.one_of_each_group(df.limit(0)).count() == 0


def test_one_row_stays_of_repeated_rows(spark):
    words = "one two three four five six seven eight".split()
    rows = [(5, " ".join(words)), (5, " ".join(words)), (9, " ".join(words)), (7, "quite another text stands here"),
            (None, "rows without an id"), (None, "rows without an id"), (3, None), (3, None), (4, ""), (8, "a single text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit("x")).withColumn("k_id", F.lit(1))
    out = simhash.one_of_each_group(df)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns
    assert sorted(map(str, got)) == sorted(str((i, t, "x", 1)) for i, t in
        [(5, " ".join(words)), (7, "quite another text stands here"), (None, "rows without an id"), (3, None), (8, "a single text of its own")])
    single = simhash.one_of_each_group(df.filter("doc_id in (7, 8, 9)"))
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert single.count() == 3 and "Aggregate" not in plan


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_ball_hashing_finds_every_component(spark, bits):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(10)]
    values = sorted({c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))})
                     for c in centres for _ in range(40)}, key=signed)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long").repartition(3)
    links = simhash.links(df, bits)
    for r in links.collect():
        assert bin((r.a ^ r.b) % (1 << 64)).count("1") <= bits
    root = {r.node: r.root for r in simhash.components(links).collect()}
    least = {}
    groups = slow_components(values, bits)
    for v, g in zip(values, groups):
        least.setdefault(g, signed(v))
    assert [root.get(signed(v), signed(v)) for v in values] == [least[g] for g in groups]


def slow_items(docs, items, threshold=0.8):
    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    out = set()
    for d, t in docs:
        own = shingles(t)
        for i, s in items:
            want = shingles(s)
            if want and len(own & want) >= threshold * len(want):
                out.add((d, i, len(own & want), len(want)))
    return out


@pytest.mark.parametrize("limit", [0, decontaminate.BROADCAST_ROWS])
def test_decontamination_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(50)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 5, 6, 12, 40])))) for k in range(30)]
    items += [(50, None), (51, ""), (3, items[3][1]), (None, items[4][1])]
    docs = []
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        inside = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randint(0, 2)):
            if inside:
                inside[rng.randrange(len(inside))] = "changed"
        docs.append((k, " ".join(words + inside).replace("v1 ", "V1, ")))
    docs += [(100, None), (101, ""), (7, docs[7][1]), (None, docs[8][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_shared", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.find_items(d, i).collect()}
    want = slow_items(docs, items)
    assert got == want and want
    bad = {(x[0]) for x in want}
    kept = decontaminate.decontaminate(d, i).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(k) for k, _ in docs if k not in bad)
    assert decontaminate.find_items(d.limit(0), i).count() == decontaminate.find_items(d, i.limit(0)).count() == 0


def test_decontamination_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op5_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10 ** 6, "", "en", "s", 0), (10 ** 6 + 1, "x" * 9000, "en", "s", 9000)],
                                docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("component_id", F.lit(1))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name != "bpe_encoding":
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert 0 < after.count() <= docs.count()
        docs = after
    full = corpus_pipeline.run(spark, sf_dir)
    assert full.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_takes_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
