import html
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from scimetrics.llm import templates

FOLDER = "/root/testdata/sf0.001"


def text_of(page, template=frozenset()):
    return templates.main_text(page, template)


def test_rules_of_the_extraction():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
    <article><h1>A &amp; B</h1><p><b>Bold <br><p>x &lt; y&nbsp;&#233; <i>in</i>line<ul><li>one<li>two</ul>
    <form><input value="q"><p>search</p></form><aside><p>side</p></aside>
    <table><tr><td>c1<td>c2</table><section class="comments"><p>me first</p></section><p>5 < 6 and a<b class=x>c</b></article>
    <div id="sidebar"><p>more</p></div><footer>&copy;</footer></body></html>"""
    assert text_of(page).split("\n") == [
        "A & B", "Bold", "x < y é inline", "one", "two", "c1", "c2", "5 < 6 and ac",
    ]


@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>a<span>b</span>c<div>d</div>e", "abc\nd\ne"),
    ("<main><p>in</main><p>out", "in"), ("<script>x<p>", ""), ("<p title='a > b'>c", "c"), ("<p title='a>c", "c"),
    ("<article>1</article><article class=comment>2</article><article>3</article>", "1\n3"), ("<" * 50, "<" * 50),
    ("</p></div>x<br/>y", "x y"), ("<b>" * 3000 + "deep", "deep"),
])
def test_broken_markup(page, want):
    assert text_of(page) == want


def page(i, body, site="s"):
    return (i, f"https://{site}.example/{i}", body)


def test_recurring_subtrees_go(spark):
    box = '<div><span>Follow us</span><ul><li>a<li>b</ul></div>'
    rows = [page(i, f"<article><h1>t{i}</h1><p>license</p>{box}<p>body {i}</p></article>") for i in range(6)]
    # copies of one page, and the same box on a host with few pages
    rows += [page(20 + i, "<article><div>only mine</div><p>same</p></article>") for i in range(9)]
    rows += [page(50 + i, f"<article>{box}<p>{i}</p></article>", "few") for i in range(3)]
    rows += [(60, None, None), (None, "https://s.example/", "<p>x"), (61, "no url", "<p>y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    got = {r.page_id: r for r in templates.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[0].text == "t0\nlicense\nbody 0" and got[0].n_chars == 17
    assert got[20].text == "only mine\nsame"
    assert got[50].text == "Follow us\na\nb\n0"
    assert (got[60].text, got[60].n_chars, got[None].text, got[61].text) == ("", 0, "x", "y")


@pytest.mark.parametrize("body, want", [
    ('<article class="post comments-open"><p>Hello</p></article>', "Hello"),
    ('<div class="layout has-sidebar"><article><p>Hello</p></article></div>', "Hello"),
    ('<article><div class="related-work"><p>Hello</p></div></article>', "Hello"),
    ('<form id="all"><article><p>Hello</p><form><p>q</p></form></article></form>', "Hello"),
    ('<div class="widget"><article><p>Hello</p></article></div>', "Hello"),
    ('<div class="related"><article><p>Teaser</p></article></div><div><p>Hello</p></div>', "Hello"),
    ('<div class="ad">Buy</div>', ""),
    ('<article><p>Hello</p><div class="comment-list"><p>me</p></div><div id="site-footer">f</div></article>', "Hello"),
    ('<article><p>Hello</p></article><article class="comment"><p>me</p></article>', "Hello"),
])
def test_whole_names_decide_and_the_article_stays(body, want):
    assert text_of(f"<html><body>{body}</body></html>") == want


def test_inline_elements_and_rare_subtrees_stay(spark):
    rows = [page(i, f"<article><p>Water is <span>H2O</span> and text {i}</p></article>") for i in range(8)]
    box = "<div><p>once in a while</p></div>"
    rows += [page(100 + i, f"<article><p>{i}</p>{box if i < 6 else ''}</article>", "large") for i in range(130)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert got[3] == "Water is H2O and text 3"
    assert got[100] == "0\nonce in a while" and got[120] == "20"


def test_pages_without_marks_lose_what_recurs(spark):
    rows = [
        page(i, f"<html><body><div><p>Menu</p><p>Home</p></div><h2>Introduction</h2><div><p>story {i}</p><p>more {i}</p></div>"
                "<p>All rights reserved</p></body></html>")
        for i in range(6)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in templates.extract(df).collect()}
    assert all(got[i] == f"Introduction\nstory {i}\nmore {i}" for i in range(6))
    count = templates.template_subtrees(df.withColumn("no_id", F.lit(False))).first().template
    assert len(count) == 4


def test_synthetic_pages(spark):
    rows = duckdb.sql(f"select page_id, html from '{FOLDER}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in templates.extract(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()}
    for page_id, text in rows:
        article = re.search("<article>(.*)</article>", text, re.S).group(1)
        blocks = [re.sub("<[^>]*>", " ", b) for b in re.split("</?(?:h1|p)>", article)]
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert got[page_id] == "\n".join(b for b in want if b)


def test_empty_table(spark):
    assert templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
