"""Row-wise operators (1, 6, 7, 10) against independent checks, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termweave.llm import bpe, html_content, labelled_pages, licenses, queries, rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t", "a", "Straße  ΑΣ ς İİ é", "x" * 5000, "<|endoftext|>a<|startoftext|>",
        "it's 12½ ²\x1c\x1dq  z w", "word " * 3000]


def clashing(spark, texts):
    """A table with repeated rows, null ids and columns named like results."""
    rows = [(k if k % 5 else None, t, "x", 7, -1) for k, t in enumerate([*texts, *texts[:3]])]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, ids int")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary_path())


def test_bpe_matches_the_library(spark, sf_dir, library):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + EDGE
    rng = random.Random(5)
    alphabet = "aabcdeefghiklmnoorsttu  '''sdlvem12 éßñ漢ΣİςΆ!?…\x1c\x85"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    path = queries.vocabulary_path()
    out = bpe.decode(bpe.encode(df, path), path).collect()
    for r in out:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_words_made_of_the_vocabulary(library):
    v = bpe.Vocabulary.load(queries.vocabulary_path())
    enc = bpe.Encoder(v)
    rng = random.Random(1)
    parts = [t.replace(v.word_end, "") for t in v.tokens[:49000] if t]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(3))
        assert list(enc.encode(s)) == library.encode(s, add_special_tokens=False).ids


def test_bpe_query_digests(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op1_bpe"](spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_row_operators_take_clashing_columns_and_empty_tables(spark):
    df = clashing(spark, EDGE)
    path = queries.vocabulary_path()
    for make in (lambda d: bpe.encode(d, path), lambda d: rules.measured_cascade(d, order=[0, 1, 2, 3, 4, 5]),
                 lambda d: rules.cascade(d), licenses.scan,
                 lambda d: html_content.extract(d.withColumnRenamed("text", "html"))):
        assert make(df).count() == df.count()
        assert make(df.limit(0)).count() == 0
        assert len(set(make(df).columns)) == len(make(df).columns)


def slow_measures(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))


def test_rule_measures_against_brute_force(spark):
    rng = random.Random(2)
    texts = EDGE + [" ".join(rng.choice(["a", "b", "c#", "d\n", "e\n\n"]) for _ in range(rng.randint(0, 120)))
                    for _ in range(150)]
    for order in ([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0]):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        for r in rules.measured_cascade(df, order=order).collect():
            want = slow_measures(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r.kept == all(not x.rejects(rules.Document(texts[r.doc_id])) for x in rules.RULES)


def test_rule_order_puts_cheap_rejections_first(spark):
    df = spark.createDataFrame([(k, "too short") for k in range(60)], "doc_id long, text string")
    order = rules.rule_order(df, "text")
    assert sorted(order) == list(range(len(rules.RULES)))
    never = {k for k, r in enumerate(rules.RULES) if not r.rejects(rules.Document("too short"))}
    assert set(order[len(order) - len(never):]) == never


def test_licence_base_phrases_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["cc", "by", "CC", "General", "public", "license", "all", "rights", "reserved", ",", "-", "é", "the"]
    texts = EDGE + [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at, names = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            hits = [k for k in range(len(words)) if words[k:k + len(p)] == p]
            at += hits
            names |= {label} if hits else set()
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == (min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(names)) and set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_template_automaton_against_a_regular_expression():
    def as_pattern(template):
        out = []
        for token in licenses._TOKEN.findall(template):
            out.append("(?:" if token == "[[" else ")?" if token == "]]" else
                       r"(?:\w+ ){0,%s}" % token[2:-2] if token[:2] == "{{" else re.escape(token) + " ")
        return re.compile("".join(out))

    rng = random.Random(4)
    for template in ["a [[b c]] {{2}} d", "[[x]] a b [[c]] d", "a {{1}} b {{1}} a", "a [[b [[c]] d]] e"]:
        auto, pattern = licenses.compile_template(template), as_pattern(template)
        for _ in range(2000):
            words = [rng.choice("abcdex") for _ in range(rng.randint(0, 9))]
            got = auto.accepts(words, 0) >= 0
            assert got == bool(pattern.match(" ".join(words) + " ")), (template, words)


def test_licence_notices():
    s = licenses.Scanner(licenses.BASE, licenses.TEMPLATES)
    for text, label in [("This work is licensed under the GNU General Public License, version 3.", "gpl-notice"),
                        ("Released under the MIT License.", "mit-notice"),
                        ("Licensed under the Apache License, Version 2.0.", "apache-notice"),
                        ("Copyright (c) 2020 A. B. All rights reserved.", "all-rights-notice"),
                        ("Licensed under CC BY-NC 4.0.", "cc-by-notice")]:
        assert label in s.scan(text)[5].split(",")
    assert s.scan("the general idea of a public license")[4:] == ("", "", 0.0)


def test_html_labelled_pages_are_learned():
    pages = labelled_pages.labelled_pages()
    model = html_content.train(pages)
    right = total = 0
    for page in pages:
        nodes = html_content.parse(page)
        for k, (y, p) in enumerate(zip(html_content.labels_of(nodes), model.marginals(nodes))):
            if nodes[k].tag == "#text":
                total += 1
                right += (p > 0.5) == bool(y)
    assert right >= 0.98 * total


def test_html_marginals_are_exact():
    """Sum-product on a small tree equals the sum over all labellings."""
    import itertools
    import math
    model = html_content.train(labelled_pages.labelled_pages())
    nodes = html_content.parse("<div class=ad><p>Buy now.</p></div><article><h1>Title</h1><p>A text.</article>")
    n, weight, of = len(nodes), Counter(), html_content.kinds(nodes)
    for y in itertools.product((0, 1), repeat=n):
        w = html_content._both(model.root)[y[0]]
        for k in range(n):
            if k:
                w += model.edge(of[k])[y[nodes[k].parent]][y[k]]
            if nodes[k].tag == "#text":
                w += sum(model.weight * model.shown.get(f, (0, 0))[y[k]] for f in html_content.evidence(nodes[k]))
        weight["all"] += math.exp(w)
        for k in range(n):
            weight[k] += math.exp(w) * y[k]
    for k, p in enumerate(model.marginals(nodes)):
        assert abs(p - weight[k] / weight["all"]) < 1e-9


BODY = "The ferry ran again on Monday after the storm, and the harbour master thanked everyone who had helped. " * 2


@pytest.mark.parametrize("page,text", [
    (f"<div><p>{BODY}</p></div><div class=bottom>Copyright 2020</div>", BODY.strip()),
    (f"<table><tr><td><a href=/>Home</a></td></tr></table><table><tr><td><h1>Ferry</h1><p>{BODY}</p></td></tr></table>",
     "Ferry\n" + BODY.strip()),
    (f"<ul class=x7><li><a href=/>Home</a></li><li><a href=/2>Ships</a></li></ul><section><p>{BODY}</p></section>"
     "<div>&copy; 2021 Harbour News</div>", BODY.strip()),
    (f"<article><p>{BODY}</p><p hidden>Not shown.</p><div hidden><p>No.</p></div><p hidden=until-found>Found, when "
     "searched.</p></article>", BODY.strip() + "\nFound, when searched."),
    (f"<article><p>{BODY}</p><p>All rights reserved.</p></article>", BODY.strip() + "\nAll rights reserved.")])
def test_html_of_layouts_not_trained_on(page, text):
    model = html_content.train(labelled_pages.labelled_pages())
    assert html_content.main_text(model, page) == text


def test_html_unclosed_tags_and_stray_ends_take_linear_time():
    import time
    began = time.perf_counter()
    for part in ("<span>x</i>", "<div>x</p></b>", "<b><p>x", "<li>x</ul>"):
        nodes = html_content.parse(part * 100_000)
        assert sum(len("".join(n.text)) for n in nodes) == 100_000
    assert time.perf_counter() - began < 20


def test_html_extracts_articles(spark, sf_dir):
    out = queries.QUERIES["op10_html"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html
    for r in out:
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br" in x else "", x)).split())
                  for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize("odd", ["<![foo[x]]>", "<![ endif]-->", "<![endif]-->", "<![endif]>", "<![if !IE]>", "<!foo>", "<!>",
                                 "<![CDATA[x]]>", "<![>", "<!-- c -->", "<!doctype html>", "<!--[if IE]><p>no</p><![endif]-->"])
def test_html_text_after_a_declaration_survives(odd):
    texts = [html_content.block_text(n) for n in html_content.parse(f"<p>one</p>{odd}<p>two</p><p>three ]> four</p>")
             if n.tag == "#text"]
    assert texts[0] == "one" and texts[-2:] == ["two", "three ]> four"]


@pytest.mark.parametrize("inside", ["<noscript>{}</noscript>", "<object data=x>{}</object>", "<canvas>{}</canvas>",
                                    "<svg><text>{}</text></svg>", "<svg><text><![CDATA[{}]]></text></svg>", "<iframe>{}</iframe>",
                                    "<p>so <math><mtext>{}</mtext></math> holds.</p>"])
def test_html_text_of_embedded_elements_in_an_article_stays(inside):
    model = html_content.train(labelled_pages.labelled_pages())
    words = "The table shows how the water level rose over the last ten years in three towns."
    page = f"<nav><a href=/>Home</a></nav><article><h1>Water</h1><p>It rose.</p>{inside.format(words)}<p>It fell.</p></article>"
    assert words in html_content.main_text(model, page)
    assert "Home" not in html_content.main_text(model, page)


def test_html_formula_stays_in_its_sentence():
    model = html_content.train(labelled_pages.labelled_pages())
    page = "<article><h1>A</h1><p>Here <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math> holds for all.</p></article>"
    assert html_content.main_text(model, page) == "A\nHere x=y2 holds for all."


def test_html_parser_reads_any_markup():
    rng = random.Random(3)
    parts = ["<!", "<![", "[", "]", "]]>", ">", "-->", "<!--", "<p>", "</p>", "</", "<", "<?", "a", " ", "&", "&#x;", "endif", "'", '"', "="]
    for _ in range(3000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert html_content.parse(html)[0].tag == "#root"


def test_html_edges():
    model = html_content.train(labelled_pages.labelled_pages())
    for page in (None, "", "<", "<p", "<![bad", "</div></p>", "<script>x", "<div>" * 500 + "x", "\x00<p>\x00"):
        assert isinstance(html_content.main_text(model, page), str)
    body = "<article><h1>A &amp; B</h1><p>One\n two&nbsp;three &#233; <b>bold</b>. <p>Two<br>lines here, yes.</article>"
    assert html_content.main_text(model, f"<nav><a href=/>Home</a></nav>{body}<footer>&copy; x</footer>") == \
        "A & B\nOne two three é bold.\nTwo lines here, yes."


def test_quality_stage_keeps_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit("mine"))
    out = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.filter("kept = 'mine'").count() == out.count() > 0
