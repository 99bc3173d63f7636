"""Cleanup (C1-C10): one table of small pages per rule, and properties that
hold for any page. Limits, suffix and allow-list are the fixed values."""

import pytest
from pyspark.sql import functions as F

from helpers import attrs_of, clean_one, pages_df
from pagemill.operators.clean import clean_nodes, cleaned_html, same_host_relative

# Fixed values.
TEXT_LIMIT, ATTRIBUTE_LIMIT, ATTRIBUTE_KEPT, SUFFIX = 120, 100, 85, " (truncated...)"

# rule -> (markup, cleaned body)
MARKUP = {
    "only the body stays": ("<html><head><title>no</title><base href='/'></head><body><b>yes</b></body></html>", "<b>yes</b>"),
    "code and styles go": ("<i>a</i><style>i{}</style><script>let b</script><i>d</i>", "<i>a</i><i>d</i>"),
    "embedded documents go": ("<h2>a</h2><iframe src='/f'>x</iframe><object data='/o'></object><embed src='/e'>", "<h2>a</h2>"),
    "pictures that cannot be read go": ("<svg><path d='M0'></path></svg><canvas></canvas><u>a</u><picture><source></picture>", "<u>a</u>"),
    "sound and film go": ("<audio src='s'></audio><u>a</u><video src='v'><track></video>", "<u>a</u>"),
    "comments go": ("<!--1--><u>a<!--2--></u><!--3-->", "<u>a</u>"),
    "empty elements go up to the first that holds something": ("<ul><li><b></b></li><li>x</li></ul><section><p><i></i></p></section>", "<ul><li>x</li></ul>"),
    "an attribute keeps an empty element": ("<p><a name='top'></a></p><img alt='m'>", '<p></p><img alt="m">'),
    "entities are read before tags": ("&#x3C;em title=&#x22;q&#x22;&#x3E;1 &amp;lt; 2&#x3C;/em&#x3E;", '<em title="q">1 &lt; 2</em>'),
}


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = cleaned_html(pages_df(spark, [m for m, _ in MARKUP.values()])).collect()
    return {name: next(r["cleaned_html"] for r in rows if r["page_id"] == i) for i, name in enumerate(MARKUP)}


@pytest.mark.parametrize("rule", [r for r in MARKUP if not r.startswith("an attribute keeps")])
def test_markup(cleaned, rule):
    assert MARKUP[rule][1] in cleaned[rule]
    if "stays" not in rule:
        assert cleaned[rule].replace("<html>", "").replace("<body>", "").replace("<head></head>", "").replace("</body></html>", "") == MARKUP[rule][1]


@pytest.mark.parametrize("n", [TEXT_LIMIT - 1, TEXT_LIMIT, TEXT_LIMIT + 1, 4 * TEXT_LIMIT])
def test_text_limit(spark, n):
    text = ("lorem" * n)[:n]
    out = clean_one(spark, f"<p>{text}</p>")
    assert (f"<p>{text}</p>" in out) == (n <= TEXT_LIMIT)
    assert (SUFFIX in out) == (n > TEXT_LIMIT)


@pytest.mark.parametrize("n", [ATTRIBUTE_KEPT, ATTRIBUTE_LIMIT, ATTRIBUTE_LIMIT + 1, 3 * ATTRIBUTE_LIMIT])
def test_attribute_limit(spark, n):
    value = ("ipsum " * n)[:n - 1] + "."
    nodes = clean_nodes(pages_df(spark, [f'<q title="{value}" alt="{value}" id="{"k" * n}" class="{"c" * n}">w</q>']))
    (a,) = attrs_of(nodes, "q")
    want = value if n <= ATTRIBUTE_LIMIT else value[:ATTRIBUTE_KEPT] + SUFFIX
    assert a["title"] == a["alt"] == want
    assert a["id"] == "k" * n and a["class"] == "c" * n


def test_allowed_attributes(spark):
    nodes = clean_nodes(pages_df(spark, ['<img class="wide" data-zoom="2" src="/m.png" alt="map" style="top:0" height="9" onload="f()" border="1">']))
    assert attrs_of(nodes, "img") == [{"class": "wide", "data-zoom": "2", "src": "/m.png", "alt": "map"}]


def test_generated_names(spark):
    html = ('<div class="q8Zt5RwYx2KvNpLm7DfB  lead-text" id="story-48213" data-k="0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9" data-ok="footer">t</div>'
            '<span class="a  b">u</span><i class="Xw9Kq2ZrTv7LmPn4Bs8D"></i>')
    nodes = clean_nodes(pages_df(spark, [html]))
    assert attrs_of(nodes, "div") == [{"class": "lead-text", "data-ok": "footer"}]
    assert attrs_of(nodes, "span") == [{"class": "a  b"}]  # nothing removed: white space as it was
    assert attrs_of(nodes, "i") == []  # its only attribute was generated, so it is empty


SITE = "https://shop.example.org/list?p=1"
LINKS = [
    ("https://shop.example.org", "/"), ("https://shop.example.org/", "/"), ("http://SHOP.example.org/a?b=c#d", "/a?b=c#d"),
    ("//shop.example.org/i.png", "/i.png"), ("https://shop.example.org:8443/a", "/a"), ("https://shop.example.org?q", "/?q"),
    ("https://cdn.example.org/a", "https://cdn.example.org/a"), ("/here", "/here"), ("mailto:a@shop.example.org", "mailto:a@shop.example.org"),
    ("ftp://shop.example.org/a", "ftp://shop.example.org/a"), ("", ""),
    ("https://shop.example.org/a b?q=1 2#x y", "/a%20b?q=1%202#x%20y"), ("https://shop.example.org/a/../b/./c", "/b/c"),
    ("https://shop.example.org/a/b/..", "/a/"), ("https://shop.example.org/../../x", "/x"), ("https://shop.example.org/%2e%2E/é?ü", "/%C3%A9?%C3%BC"),
    ("https://shop.example.org/a\\b", "/a/b"), ("https://shop.example.org/?#", "/"), (" https://shop.example.org/t\t ", "/t"),
]


def test_links(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LINKS)], "i int, v string")
    got = {r["i"]: r["w"] for r in df.select("i", same_host_relative(F.col("v"), F.lit(SITE)).alias("w")).collect()}
    assert [got[i] for i in range(len(LINKS))] == [w for _, w in LINKS]


@pytest.mark.parametrize("page,want", [(SITE, "/go?to=1"), ("%%%", "https://shop.example.org/go?to=1")])
def test_links_in_a_page(spark, page, want):
    nodes = clean_nodes(pages_df(spark, ['<form action="https://shop.example.org/go?to=1"><a href="https://shop.example.org/go?to=1">g</a></form>'], url=page))
    assert attrs_of(nodes, "form") == [{"action": want}] and attrs_of(nodes, "a") == [{"href": want}]


def test_cleaning_twice_changes_nothing(spark):
    once = clean_one(spark, "<div><p>a <b>b</b></p><!-- x --><br><span></span></div>")
    assert cleaned_html(pages_df(spark, [once])).collect()[0]["cleaned_html"] == once


def test_punycode_is_that_of_the_codec(spark):
    import random

    from pagemill.functions.text import canonical_host, punycode

    rng = random.Random(3)
    labels = ["b\u00fccher", "\u4f8b\u3048", "a-\u00fc-b", "\U0001f600x", "\u0430\u0431\u0432", "\u00e9" * 30, "x" * 40 + "\u00df"]
    labels += ["".join(rng.choice("abc-09\u00e4\u00f6\u0436\u4e2d\u6587\uac00\U00010330") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    labels = sorted({x for x in labels if not x.isascii()})
    got = {r.l: r.p for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", punycode(F.col("l")).alias("p")).collect()}
    assert got == {x: x.encode("punycode").decode() for x in labels}
    hosts = {"B\u00dccher.Example": "xn--bcher-kva.example", "ex%41mple.com": "example.com", "m\u3002b\u00fccher\uff0ede": "m.xn--bcher-kva.de", "a.b": "a.b", "%zz": "%zz"}
    assert {r.h: r.c for r in spark.createDataFrame([(x,) for x in hosts], "h string").select("h", canonical_host(F.col("h")).alias("c")).collect()} == hosts


@pytest.mark.parametrize("base,link,want", [
    ("http://e.com/p", "http://e.com\\a\\b?x=\\y", "/a/b?x=\\y"), ("http://e.com/p", "http:\\\\e.com\\a", "/a"), ("http://b\u00fccher.example/p", "https://xn--bcher-kva.example/x", "/x"),
    ("http://xn--bcher-kva.example/p", "//B\u00dcCHER.example:80/x#y", "/x#y"), ("http://e.com/p", "http://%65.com/x", "/x"), ("http://e.com/p", "http://f.com\\a", "http://f.com\\a"), ("not a url", "http://e.com/x", "http://e.com/x"),
])
def test_links_whose_host_is_spelled_otherwise(spark, base, link, want):
    from pagemill.operators.clean import same_host_relative

    row = spark.createDataFrame([(base, link)], "base string, link string").select(same_host_relative(F.col("link"), F.col("base")).alias("out")).first()
    assert row.out == want


def test_two_captures_of_one_address_are_two_pages(spark, tmp_path):
    from pagemill.sources.pages import read_page_json, write_snapshots

    rows = [(1, "https://e.com/", "<p>a</p>"), (2, "https://e.com/", "<p>b</p>"), (3, "https://e.com/", "<p>a</p>"), (4, "https://f.com/", "<p>a</p>")]
    write_snapshots(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "s"))
    back = read_page_json(spark, str(tmp_path / "s")).collect()
    assert len({r.page_id for r in back}) == len(back) == 3
