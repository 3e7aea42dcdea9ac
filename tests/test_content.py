"""Page-content extraction on hand-made markup (FIXTURES.md section 3)."""

import pytest

from termweave.operators import content as C
from termweave.functions.markup import parse_nodes


def wrap(body):
    return f"<html><body>{body}</body></html>"


def extract(spark, html):
    df = spark.createDataFrame([(1, "http://x.org/a", html)], "page_id bigint, url string, html string")
    return C.page_content(df).first().asDict()


@pytest.mark.parametrize("html,expected", [
    (wrap("<p>one <b>two</b><br>three</p>"), "onetwothree"),
    (wrap("<p>a <!-- x --> b</p>"), "ab"),
    (wrap("<li><p>a</p>b</li>"), "ab a"),
    (wrap("<p>a<p>b</p>"), "ab b"),
    ("<p>a</p>", ""),
    (wrap("<p></p><p>x</p>"), " x"),
    (wrap("<nav><p>n</p></nav><p>k</p>"), "k"),
    (wrap("<div>d</div><p>k</p><span>s</span>"), "k"),
    (wrap("<p>a<script>var t='</p>';</script>b</p>"), "ab"),
])
def test_body_text(spark, html, expected):
    assert extract(spark, html)["body_text"] == expected


def test_headings_and_header_exclusion(spark):
    r = extract(spark, wrap("<header><h1>x</h1></header><h2></h2><h2>y</h2><h4>z</h4>"))
    assert r["h1"] == []
    assert r["h2"] == ["", "y"]
    assert r["h4"] == ["z"]
    assert "z" not in r["all_text"]


def test_meta_title_alt(spark):
    html = ('<html><head><title> T &amp; U </title><meta name="Description" content="no">'
            '<meta name="description" content=" yes "></head><body>'
            '<img alt=" a "><img alt=""><img src="x"><p>p</p></body></html>')
    r = extract(spark, html)
    assert r["title"] == "T & U"
    assert r["meta_description"] == " yes "
    assert r["images_alt"] == ["a"]
    assert r["all_text"] == "T & U  yes  p a"
    assert r["text_length"] == len(r["all_text"])


def test_meta_name_case(spark):
    r = extract(spark, '<html><head><meta name="Description" content="x"></head><body></body></html>')
    assert r["meta_description"] == ""


def test_truncated_document(spark):
    r = extract(spark, "<html><body><p>a<li>b")
    assert r["body_text"] == "ab b"


def test_null_page(spark):
    df = spark.createDataFrame([(1, "u", None)], "page_id bigint, url string, html string")
    r = C.page_content(df).first()
    assert r["all_text"] is None


def test_node_stream_shape():
    s = parse_nodes(wrap("<p>a<b>b</b></p>"))
    tags = [e["tag"] for e in s["elements"]]
    assert tags == ["html", "body", "p", "b"]
    p = s["elements"][2]
    assert s["texts"][p["t0"]:p["t1"]] == ["a", "b"]
    assert p["last"] == 3


def test_unclosed_tags_and_stray_ends_cost_nothing():
    import time

    from termweave.functions.markup import parse_nodes

    page = "<body>" + "<span>a</i></b>" * 100_000 + "<p>end</p>"
    start = time.time()
    nodes = parse_nodes(page)
    assert time.time() - start < 4
    assert len(nodes["elements"]) == 100_002 and nodes["texts"][-1] == "end"
    # the same shape as a small page: every span stays open to the end
    assert {e["last"] for e in nodes["elements"][:3]} == {100_001}
