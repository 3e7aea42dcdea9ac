"""The corpus pipeline against a plain Python version of its five stages."""

import hashlib
import random
import re
import unicodedata

import pytest
import xxhash

import corpus_pipeline
from termweave.llm import queries

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def passes_rules(text):
    words = SPACE_WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE_WORDS.search(x)]
    triples = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {p for i, t in enumerate(triples) if triples.count(t) > 1 for p in (i, i + 1, i + 2)}
    chars = sum(map(len, words))
    letters = sum(unicodedata.category(c)[0] == "L" for c in text or "")
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n = len(words)
    return not (n < 50 or 100 * len(again) > 50 * n or 10 * symbols > 3 * n or 2 * (len(lines) - len(set(lines))) > len(lines)
                or chars < 2 * n or chars > 14 * n or 2 * letters < chars)


def fingerprint(text):
    words = SPACE_WORDS.findall(text.translate(LOWER))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each_group(rows):
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    prints = [fingerprint(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                if x != y:
                    group[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    return [r for k, r in enumerate(rows) if root(k) == k]


def cut_repeats(rows, window=100):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0], r[1].encode())):
        raw = text.encode()
        cut = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i:i + window] in seen:
                cut[i:i + window] = b"\x01" * window
            seen.add(raw[i:i + window])
        out.append((key, bytes(b for b, c in zip(raw, cut) if not c).decode("utf-8", "ignore")))
    return out


def shingles(text):
    words = WORDS.findall(text.translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def without_items(rows, items):
    held = [s for s in map(shingles, items) if s]
    return [r for r in rows if not any(len(shingles(r[1]) & s) >= 0.8 * len(s) for s in held)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    stock = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 9))) for _ in range(900)] + ["Été", "großer", "naïve"]
    prose = lambda n: " ".join(rng.choices(stock, k=n))
    passage, items = prose(45), [prose(18), prose(25), "too short"]
    texts = [prose(rng.randint(60, 220)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[4] + " tail", texts[5].replace(" ", "\n", 3)]
    texts += [f"{prose(60)} {passage} {prose(40)}" for _ in range(4)]
    texts += [f"{prose(70)} {item} {prose(50)}" for item in items]
    texts += [None, "", "few words only", " ".join(["same old words"] * 40), "# * $ % & " * 30 + prose(50),
              "\n".join(["one line again"] * 9) + prose(50), " ".join("a" for _ in range(80)), prose(90) + " 漢字 🙂"]
    rows = [(10 * k + 3, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows, items


def test_run_equals_the_stages_in_plain_python(spark, tmp_path, corpus):
    from tokenizers import Tokenizer

    rows, items = corpus
    table = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [r for r in rows if passes_rules(r[1])]
    single = one_of_each_group(good)
    cut = cut_repeats(single)
    clean = without_items(cut, items)
    # every stage has work to do, and leaves work to the next
    assert len(rows) > len(good) > len(single) > len(clean) > 25
    assert dict(cut) != dict(single)

    library = Tokenizer.from_file(queries.vocabulary_path())
    want = {}
    for i, text in clean:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), ids, hashlib.sha256(decoded.encode()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in got} == want


def test_stages_keep_the_columns_of_the_documents(spark, tmp_path, corpus):
    rows, items = corpus
    table = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [r for r in rows if passes_rules(r[1])]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:4], (None, one_of_each_group, cut_repeats,
                                                                lambda r: without_items(r, items))):
        want = step(want) if step else want
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
        assert all((r.lang, r.source, r.n_chars) == ("en", f"s{r.doc_id % 4}", len(r.text)) for r in docs.collect())
