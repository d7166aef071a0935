"""Canonical links and refreshes in every form that leads to a blocked URL."""

import pytest

from meterloom.llm.url_filter import judge_urls, links_of

PAGE = "https://a.test/d/e/1.html?q"
FORMS = {
    '<link rel=canonical href="page.html">': ["http://a.test/d/e/page.html"],
    "<link rel='canonical' href='../x'>": ["http://a.test/d/x"],
    '<link rel="canonical" href="?id=3">': ["http://a.test/d/e/1.html?id=3"],
    '<link rel="canonical" href="https://bad.test/b?x=1&amp;y=2">': ["https://bad.test/b?x=1&y=2"],
    '<link href="//bad.test/b" rel="alternate canonical">': ["http://bad.test/b"],
    '<link rel=canonical href="/1"><LINK REL=canonical HREF="/2">': ["http://a.test/1", "http://a.test/2"],
    """<meta content="0; url='next'" http-equiv=Refresh>""": ["http://a.test/d/e/next"],
    '<link title="a > b" rel="canonical" href="/3">': ["http://a.test/3"],
    '<link rel="stylesheet" href="/4"><meta name="canonical" content="0; url=/5">': [],
}


@pytest.mark.parametrize("text", FORMS)
def test_links_of(text):
    assert links_of(PAGE, text) == FORMS[text]


def test_blocks_reach_pages_by_every_form(spark):
    pages = [(i, f"http://bad.test/ok/{i}.html", x) for i, x in enumerate(['<link rel=canonical href="../b/1?x=1&amp;y=2">', '<link rel="alternate canonical" href="../b/2">', '<link rel=canonical href="z"><link rel=canonical href="/b/3">', '<link rel=stylesheet href="/b/3">'])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(df, [("bad.test", "/b/", "block")]).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow"}


def test_a_megabyte_tag_is_read_in_linear_time():
    import time

    start = time.time()
    assert links_of(PAGE, "<link " + "a" * 1_000_000 + ">") == []
    assert links_of(PAGE, "<link " + "a=" * 300_000 + ' rel=canonical href="/z">') == ["http://a.test/z"]
    assert time.time() - start < 1
