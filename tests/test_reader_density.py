"""Composite text density against a walk over the tree, and what comes out of pages."""
from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from pagemill.operators import reader as R
from pagemill.operators.nodes import parse_pages


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5) if depth < 4 else 1):
        x = rng.random()
        if x < 0.45 and depth < 4:
            out.append(f"<div>{random_page(rng, depth + 1)}</div>")
        elif x < 0.75:
            out.append(f"<p>{'word ' * rng.randrange(40)}<b>bold {'x' * rng.randrange(9)}</b> <a href='/'>{'l' * rng.randrange(9)}</a></p>")
        elif x < 0.9:
            out.append("<ul>" + "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(rng.randrange(6))) + "</ul>")
        else:
            out.append("loose text <script>var hidden = 1</script>")
    return "".join(out)


def brute(rows):
    """(densities by pre, content pres) with plain loops."""
    by = {r["pre"]: r for r in rows}
    parents = {r["pre"]: r["parent"] for r in rows}

    def up(p):
        while p in by:
            yield by[p]
            p = parents[p]

    tags = {r["pre"]: [x["tag"] for x in up(r["pre"])] for r in rows}
    live = [r for r in rows if "body" in tags[r["pre"]] and not set(tags[r["pre"]]) & set(R.SKIP_TAGS)]
    els = [r for r in live if r["kind"] == "element"]
    inside = {e["pre"]: [x for x in live if e["pre"] <= x["pre"] <= e["pre_end"]] for e in els}

    def chars(e, want):
        return sum(len(x["text"]) for x in inside[e["pre"]] if x["kind"] == "text" and want(tags[x["pre"]]))

    body = next(e for e in els if e["tag"] == "body")
    r = chars(body, lambda t: "a" in t) / max(1, chars(body, lambda t: True))
    dens = {}
    for e in els:
        para = chars(e, lambda t: ("p" in t or "pre" in t) and "a" not in t)
        c, li = max(1, para), max(1, chars(e, lambda t: "a" in t))
        t = max(1, sum(x["kind"] == "element" and x["tag"] in R.DENSITY_TAGS for x in inside[e["pre"]]))
        a = max(1, sum(x["kind"] == "element" and x["tag"] == "a" for x in inside[e["pre"]]))
        base = math.log(c / max(c - li, 1) * li + r * c + math.e)
        dens[e["pre"]] = c / t * math.log(max(1, c / li * t / a)) / math.log(base) if para else 0.0
    sums = {e["pre"]: sum(dens[x["pre"]] for x in els if x["parent"] == e["pre"]) for e in els}
    if max(sums.values()) <= 0:
        return dens, sums, []
    top = min(sums, key=lambda p: (-round(sums[p], 9), p))
    least = min(dens[e["pre"]] for e in els if e["pre"] <= top <= e["pre_end"])
    marked = {min((x["pre"] for x in els if e["pre"] <= x["pre"] <= e["pre_end"]), key=lambda p: (-round(sums[p], 9), p)) for e in els if dens[e["pre"]] > 0 and dens[e["pre"]] >= least}
    return dens, sums, sorted(p for p in marked if not any(q != p and q <= p <= by[q]["pre_end"] for q in marked)
                               and chars(by[p], lambda t: ("p" in t or "pre" in t) and "a" not in t) >= 25)


def test_densities_and_blocks_of_random_pages(spark):
    rng = random.Random(12)
    pages = spark.createDataFrame([(i, random_page(rng)) for i in range(40)] + [(99, "<ul><li><a href='/'>only</a></li></ul>")], "page_id long, html string")
    nodes = parse_pages(pages).repartition("page_id").cache()
    of = defaultdict(list)
    for r in nodes.orderBy("page_id", "pre").collect():
        of[r["page_id"]].append(r)
    el = R.densities(nodes).cache()
    got, blocks = defaultdict(dict), defaultdict(list)
    for r in el.collect():
        got[r["page_id"]][r["pre"]] = (r["density"], r["density_sum"])
    for r in R.content_blocks(el).collect():
        blocks[r["page_id"]].append(r["pre"])
    for page, rows in of.items():
        dens, sums, kept = brute(rows)
        assert set(got[page]) == set(dens)
        for p, (d, s) in got[page].items():
            assert d == pytest.approx(dens[p]) and s == pytest.approx(sums[p])
        assert sorted(blocks[page]) == kept, page
    assert blocks[99] == []


def test_an_article_in_two_boxes_comes_out_whole_and_without_the_links_between(spark):
    para = lambda k: f"<p>{'Sentence number %d says a little more. ' % k * 8}</p>"
    links = "<ul>" + "".join(f"<li><a href='/{k}'>another story {k}</a></li>" for k in range(60)) + "</ul>"
    html = f"<html><head><title>T</title></head><body><nav>{links}</nav><div class='one'>{para(1)}{para(2)}{para(3)}</div><div>{links}</div><div class='two'>{para(4)}{para(5)}</div><footer><p>Owner 2020</p></footer></body></html>"
    pages = spark.createDataFrame([(0, "https://h.example/", html), (1, "https://h.example/2", " \n "), (2, "https://h.example/3", "<p>short</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in R.reader_mode(pages).collect()}
    text = got[0]["markdown"]
    assert got[0]["status"] == "ok" and all(f"Sentence number {k}" in text for k in range(1, 6))
    assert "another story" not in text and "Owner" not in text
    assert got[0]["meta"]["excerpt"].startswith("Sentence number 1") and got[0]["meta"]["length"] == 5 * len("Sentence number 1 says a little more. " * 8)
    assert got[1]["status"] == got[2]["status"] == "not_applicable" and got[1]["markdown"] is None


def test_blocks_of_text_and_their_neighbours(spark):
    long = "word " * 45
    html = [
        "<nav><a>one two</a> <a>three</a></nav><h1>A title of six words here</h1><p>" + long + "</p><p>few</p><p>" + "w " * 20 + "</p><p>short one</p><div>a <b>b</b>c<br>d <a>e f g</a></div>",
        "<ul><li><a>x y</a></li><li>plain</li></ul>" + "<p>" + "w " * 18 + "</p><p>" + "w " * 10 + "</p><script>no no no</script> \u00a0 <p>end</p>",
        "", "<p> </p>",
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = defaultdict(list)
    for r in R.classified_blocks(parse_pages(pages)).orderBy("page_id", "n").collect():
        got[r["page_id"]].append((r["n"], r["words"], r["link_words"], r["content"]))
    assert got == {
        0: [(1, 3, 3, False), (2, 6, 0, True), (3, 45, 0, True), (4, 1, 0, True), (5, 20, 0, True), (6, 2, 0, True), (7, 6, 3, False)],
        1: [(1, 2, 2, False), (2, 1, 0, True), (3, 18, 0, True), (4, 10, 0, True), (5, 1, 0, True)],
    }
