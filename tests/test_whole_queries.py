"""Queries without an oracle that return all of their operator's rows, against brute force on pages of another shape."""

from collections import Counter
from xml.etree import ElementTree

import pytest

from pagemill.plans.queries import queries

PAGES = [
    (1, "https://a.example.com/1", "<html><head><title>t</title></head><body><div class='top'><a href='/x'>one</a> two</div><main><p>some <b>bold</b> and <a href='/y'>linked</a></p><b>b</b></main></body></html>"),
    (2, "https://a.example.com/2", "<html><head><title>u</title></head><body><div class='top'>three</div><section><p>text</p><ul><li>x</li><li><b>y</b></li></ul></section></body></html>"),
    (3, "https://b.example.com/1", "<html><head><title>v</title></head><body><div class='top'><a href='/z'>all link</a></div></body></html>"),
]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return lambda name: queries()[name](spark, folder).collect()


def chars(e, tag=None):
    """Characters of an element's text, or of what of it is inside ``tag``."""
    if tag is None or e.tag == tag:
        return len("".join(e.itertext()))
    return sum(chars(x, tag) for x in e)


def elements():
    """(page_id, url, element, whether inside a, inside p)"""
    for i, url, html in PAGES:
        def walk(e, a, p):
            yield i, url, e, a or e.tag == "a", p or e.tag == "p"
            for x in e:
                yield from walk(x, a or e.tag == "a", p or e.tag == "p")
        yield from walk(ElementTree.fromstring(html), False, False)


def in_body(i):
    return [e for e in ElementTree.fromstring(PAGES[i - 1][2]).find("body").iter() if e.tag != "body"]


def test_all_tags(run):
    want = Counter((i, e.tag) for i, _, e, *_ in elements())
    assert {(r.page_id, r.tag): r.n for r in run("n3_tag_counts_all")} == want and want[1, "b"] == 2


def test_all_elements_left_by_cleaning(run):
    got = {r.page_id: (r.n_elements, r.text_chars) for r in run("c1_c3_clean_counts_all")}
    assert got == {i: (len(in_body(i)), chars(ElementTree.fromstring(h).find("body"))) for i, _, h in PAGES}


def test_density_of_every_element(run):
    skip = {"html", "head", "title"}
    got = Counter((r.page_id, r.tag, r.text_chars, r.link_chars, r.p_chars, round(r.link_density, 9)) for r in run("r3_density_all") if r.tag not in skip)
    want = Counter()
    for i, _, e, a, p in elements():
        if e.tag not in skip:
            n, link, par = chars(e), chars(e) if a else chars(e, "a"), chars(e) if p else chars(e, "p")
            want[i, e.tag, n, link, par, round(link / n, 9)] += 1
    assert got == want


def test_all_signatures_of_a_host(run):
    want, on = Counter(), {}
    for i, url, e, a, p in elements():
        if e.tag in ("html", "head", "title", "body"):
            continue
        key = (url.split("/")[2], f"{e.tag}.{e.get('class')}" if e.get("class") else e.tag, e.tag)
        on.setdefault(key, set()).add(i)
        for kind, n in (("text", chars(e)), ("link", chars(e) if a else chars(e, "a")), ("p", chars(e) if p else chars(e, "p"))):
            want[key, kind] += n
    pages = Counter(url.split("/")[2] for _, url, _ in PAGES)
    got = {(r.host, r.selector, r.tag): (r.pages_with, r.text_chars, r.link_chars, r.p_chars, r.support) for r in run("i2_signatures")}
    assert got == {k: (len(v), want[k, "text"], want[k, "link"], want[k, "p"], len(v) / pages[k[0]]) for k, v in on.items()}
