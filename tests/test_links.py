"""Links and bounded site visits on a hand-made page graph."""

import pytest
from pyspark.sql import functions as F

from contactloom.operators import links

GRAPH = [
    ("http://site.org", '<a href="a">1</a> <a href="/b?x=1#y">2</a>'),
    ("http://site.org/a", '<a href="http://www.site.org/c">3</a>'),
    ("http://site.org/b", '<a href="https://other.org/">4</a> <a href="mailto:x@site.org">5</a>'),
    ("http://site.org/c", '<a href="./">home</a>'),
    ("http://www.site.org/c", '<a href="http://site.org/d/../">home</a>'),
    ("https://other.org/", '<a href="/z">6</a>'),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(GRAPH)], "page_id bigint, url string, html string")


def test_resolve(spark):
    base = "https://h.org/x/y.html?q#f"
    cases = {
        "/p": "https://h.org/p",
        "p": "https://h.org/x/p",
        "./p": "https://h.org/x/p",
        "../p/../q": "https://h.org/q",
        "/a/b/..": "https://h.org/a/",
        "/../..": "https://h.org/",
        "//o.org/p": "https://o.org/p",
        "HTTP://o.org": "HTTP://o.org",
        "mailto:a@b.c": None,
        "javascript:void(0)": None,
        "?z=1": "https://h.org/x/y.html?z=1",
        "#top": "https://h.org/x/y.html#top",
        "": "https://h.org/x/y.html",
        "p?a=/../b": "https://h.org/x/p?a=/../b",
    }
    df = spark.createDataFrame([(h, base) for h in cases], "h string, b string")
    got = {r["h"]: r["v"] for r in df.select("h", links.resolve(links._base_parts(F.col("b")), F.col("h")).alias("v")).collect()}
    assert got == cases


def test_page_links(pages):
    got = sorted((r["src"], r["dst"]) for r in links.page_links(pages).collect())
    assert got == [
        ("http://site.org/", "http://site.org/a"),
        ("http://site.org/", "http://site.org/b"),
        ("http://site.org/a", "http://www.site.org/c"),
        ("http://site.org/c", "http://site.org/"),
        ("http://www.site.org/c", "http://site.org/"),
        ("https://other.org/", "https://other.org/z"),
    ]
    kept = {r["dst"] for r in links.page_links(pages, ignore_queries=False).collect()}
    assert "http://site.org/b?x=1" in kept


@pytest.mark.parametrize("depth,want", [(1, "/"), (2, "/ a b"), (3, "/ a b c"), (-1, "/ a b c")])
def test_scope(spark, pages, depth, want):
    seeds = spark.createDataFrame([("http://site.org#x",), (None,)], "url string")
    rows = links.pages_in_scope(seeds, pages, depth).collect()
    assert sorted(r["url"].rstrip("/").split("/")[-1] if r["depth"] > 1 else "/" for r in rows) == sorted(want.split())
    assert {r["host"] for r in rows} == {"site.org"}


def test_scope_cap_keeps_the_nearest(spark, pages):
    seeds = spark.createDataFrame([("http://site.org/",)], "url string")
    rows = links.pages_in_scope(seeds, pages, -1, limit_urls=2).collect()
    assert sorted((r["depth"], r["url"]) for r in rows) == [(1, "http://site.org/"), (2, "http://site.org/a")]


def test_spellings_of_href(spark):
    html = """<a href='/q'>1</a><A HREF="/r">2</A><a href=/t>3</a><a href = "/u?x=1&amp;y=2">4</a><a data-hrefs="/no">5</a>"""
    pages = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
    got = {r.dst for r in links.page_links(pages, ignore_queries=False).collect()}
    assert got == {"https://a.com/q", "https://a.com/r", "https://a.com/t", "https://a.com/u?x=1&y=2"}
