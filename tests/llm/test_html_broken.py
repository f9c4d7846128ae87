"""Broken, deep and large pages: linear time, no lost text, no failure."""

import random
import time

import pytest

from sumtrail.llm import html_wrapper

WRAP = {"way": [], "menus": []}


@pytest.mark.parametrize("page", [
    '<a "' * 250_000, "<script " * 120_000, "<" * 500_000, "<!--" * 200_000, "<script>" * 100_000, "<a '\"" * 200_000 + ">", "&" * 300_000,
    "<a '" * 100_000 + '"' * 100_000 + ">", "<!" * 300_000])
def test_a_megabyte_of_broken_tags_takes_a_moment(page):
    began = time.perf_counter()
    html_wrapper.extracted(page, WRAP)
    assert time.perf_counter() - began < 5


def test_deep_pages(spark):
    deep = ["<div>" * n + "<p>inside</p>" + "</div>" * n + "<p>after</p>" for n in (1, 150, 900, 5_000)]
    deep += ["<b>" * 5_000 + "bold" + "</b>" * 5_000, "<ul><li>" * 2_000 + "item", "<div class=content>" * 3_000 + "text"]
    df = spark.createDataFrame([(k, "http://d.org/", p) for k, p in enumerate(deep)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrapper.texts(df).collect()}
    assert [got[k] for k in range(7)] == ["inside\n\nafter"] * 4 + ["bold", "item", "text"]


def test_nothing_is_lost_between_tags():
    r = random.Random(5)
    parts = ["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "text ", "&amp;", "<br>", "<i class='x'>", '<a href="a>b">', "</a>", "<!-- no -->", "< ", "<x", ">", '"']
    for _ in range(3_000):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        joined = "".join(t for kind, t, _ in html_wrapper.tokens(page) if kind == "text")
        assert joined.count("text ") == page.count("text ") or "<x" in page or "<a" in page
        html_wrapper.extracted(page, WRAP)


def test_quoted_brackets_and_unclosed_quotes():
    tokens = lambda page: [t for t in html_wrapper.tokens(page)]
    assert tokens('<a title="x > y">z') == [("open", "a", ' title="x > y"'), ("text", "z", "")]
    assert tokens('<a title="x>z<b>') == [("open", "a", ' title="x'), ("text", "z", ""), ("open", "b", "")]
    assert tokens("a < b") == [("text", "a ", ""), ("text", "< b", "")]
    assert tokens("<SCRIPT>var a='<p>'</Script ><P>x") == [("open", "p", ""), ("text", "x", "")]


def test_title_deep_in_the_header_of_an_article(spark):
    page = "<nav>m</nav><article><header><div><h1>T</h1></div></header><p>x y z</p></article>"
    df = spark.createDataFrame([(1, "http://t.org/", page)], "page_id long, url string, html string")
    assert html_wrapper.texts(df).first().text == "T\n\nx y z"
