"""Where the fields of a page come from, and which place goes first."""
from __future__ import annotations

import json

import pytest
from helpers import pages_df
from pyspark.sql import functions as F

from pagemill.operators import reader as R
from pagemill.operators.nodes import parse_pages


def ld(value, kind="application/ld+json"):
    return f'<script type="{kind}">{value if isinstance(value, str) else json.dumps(value)}</script>'


ARTICLE = {"@context": "https://schema.org", "@type": "NewsArticle", "headline": " Told  twice ", "author": [{"name": "Ann One"}, "Bob Two", {"@id": "x"}],
           "publisher": {"name": "The Paper"}, "datePublished": "2024-05-06", "description": "In short."}

CASES = {
    "all from json": (ld(ARTICLE) + '<title>Other</title><meta name="author" content="M">',
                      {"title": "Told twice", "byline": "Ann One, Bob Two", "siteName": "The Paper", "publishedTime": "2024-05-06", "excerpt": "In short."}),
    "in a graph": (ld({"@context": {"@vocab": "http://schema.org/"}, "@graph": [{"@type": "WebSite", "name": "Site"}, {"@type": ["Thing", "BlogPosting"], "name": "Post", "author": {"name": "C"}}]}), {"title": "Post", "byline": "C"}),
    "in a list": (ld([{"@context": "https://schema.org", "@type": "Person", "name": "P"}, ARTICLE]), {"title": "Told twice", "siteName": "The Paper"}),
    "type as address": (ld(ARTICLE | {"@type": "https://schema.org/Article"}), {"title": "Told twice"}),
    "in CDATA": (ld("<![CDATA[" + json.dumps(ARTICLE) + "]]>", "Application/LD+JSON; charset=utf-8"), {"title": "Told twice"}),
    "other vocabulary": (ld(ARTICLE | {"@context": "https://example.org"}) + "<title>T</title>", {"title": "T", "byline": None}),
    "no article": (ld(ARTICLE | {"@type": "Recipe"}) + "<title>T</title>", {"title": "T", "byline": None}),
    "no json": (ld('{"@context": "https://schema.org", ') + "<title>T</title>", {"title": "T"}),
    "other kinds of value": (ld(ARTICLE | {"headline": 7, "author": 3, "publisher": "x", "datePublished": None, "description": ["a"]}) + "<title>T</title>",
                             {"title": "T", "byline": None, "siteName": None, "publishedTime": None, "excerpt": None}),
    "first of two": (ld(ARTICLE | {"headline": "A"}) + ld(ARTICLE | {"headline": "B"}), {"title": "A"}),
    "meta by rank": ('<meta name="twitter:title" content="tw"><meta property="og:title" content="og"><meta name="DC.Title" content="dc"><title>T</title>', {"title": "dc"}),
    "one meta, several names": ('<meta property="x:y og:site_name" content="S"><meta name="date" content="d"><meta property="article:published_time" content="p">', {"siteName": "S", "publishedTime": "p"}),
    "blank meta": ('<meta property="og:title" content="  "><title>T</title><meta name="description"><meta name="twitter:description" content="tw">', {"title": "T", "excerpt": "tw"}),
    "meta before items": ('<meta name="author" content="M"></head><body><p itemprop="author">I</p>', {"byline": "M"}),
    "items": ('</head><body><div itemprop="author">By <b>Ann</b> <i itemprop="name headline">One</i></div><time itemprop="datePublished" datetime="2020-01-01">long ago</time><h1>Head</h1>',
              {"byline": "By Ann One", "publishedTime": "2020-01-01", "title": "Head"}),
    "rel": ('</head><body><a rel="me author" href="/x">Ann</a><a rel="authority">No</a>', {"byline": "Ann"}),
    "title before heading": ("<title>From the title</title></head><body><h1>Heading</h1>", {"title": "From the title"}),
    "site's name behind": ("<title>A long enough head | The Site</title>", {"title": "A long enough head"}),
    "site's name in front": ("<title>Site » a long enough head</title>", {"title": "a long enough head"}),
    "short parts": ("<title>Two words - Site</title>", {"title": "Two words - Site"}),
    "two separators": ("<title>One two three - four | Site</title>", {"title": "One two three - four | Site"}),
    "hyphen in a word": ("<title>well-known things of old</title>", {"title": "well-known things of old"}),
    "second html attributes": ('<title>T</title></head><body dir="rtl">', {"lang": "de", "dir": "ltr", "title": "T"}),
    "nothing": ("", {"title": None, "byline": None, "siteName": None, "publishedTime": None, "excerpt": None, "lang": "de"}),
}


@pytest.fixture(scope="module")
def told(spark):
    nodes = parse_pages(pages_df(spark, [f'<html lang="de" dir="ltr"><head>{h}</html>' for h, _ in CASES.values()]))
    return [r.asDict() for r in R.metadata(nodes).orderBy("page_id").collect()]


@pytest.mark.parametrize("case", list(CASES))
def test_fields(told, case):
    got = told[list(CASES).index(case)]
    assert {k: got[k] for k in CASES[case][1]} == CASES[case][1]


def test_one_row_per_page_and_none_without(spark, told):
    assert [r["page_id"] for r in told] == list(range(len(CASES)))
    empty = parse_pages(pages_df(spark, ["x"]).where("false"))
    assert R.metadata(empty).collect() == [] and R.structured_data(empty).collect() == []


def test_structured_rows(spark):
    page = ld([ARTICLE, ARTICLE | {"@type": "Report", "@graph": [{"@type": "TechArticle", "headline": "T"}]}])
    rows = R.structured_data(parse_pages(pages_df(spark, [page, page]))).orderBy("page_id", "n").select("page_id", "n", "type", "title").collect()
    assert [tuple(r) for r in rows] == [(p, n, *x) for p in (0, 1) for n, x in enumerate([("NewsArticle", "Told twice"), ("Report", "Told twice"), ("TechArticle", "T")], 1)]


def test_reader_mode_returns_them(spark):
    body = "<article>" + "".join(f"<p>{'some words of a paragraph ' * 20}{k}</p>" for k in range(4)) + "</article>"
    pages = pages_df(spark, [f"<html><head>{ld(ARTICLE)}</head><body>{body}</body></html>"])
    meta = R.reader_mode(pages).select(F.col("meta.*")).collect()[0]
    assert (meta.title, meta.byline, meta.siteName, meta.publishedTime, meta.excerpt) == ("Told twice", "Ann One, Bob Two", "The Paper", "2024-05-06", "In short.")
