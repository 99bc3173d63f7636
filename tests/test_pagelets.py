"""Pagelets and templates against a walk over the tree."""
from __future__ import annotations

import random
from collections import defaultdict

from pagemill.operators import pagelets as L
from pagemill.operators.nodes import parse_pages
from pagemill.operators.structure import subtree_sums


def random_page(rng, depth=0):
    kids = []
    for _ in range(rng.randrange(1, 4) if depth < 4 else 0):
        kids.append(random_page(rng, depth + 1) if rng.random() < 0.6 else "".join(f"<a href='/{rng.randrange(9)}'>l{rng.randrange(9)}</a> " for _ in range(rng.randrange(4))) + "some words " * rng.randrange(3))
    tag = rng.choice(["div", "section", "ul"])
    return f"<{tag} class='c{rng.randrange(3)}'>" + "".join(kids) + f"</{tag}>"


def brute(rows, k):
    kids = defaultdict(list)
    for r in rows:
        if r["kind"] == "element":
            kids[r["parent"]].append(r)
    links = {r["pre"]: sum(1 for x in rows if x["kind"] == "element" and x["tag"] == "a" and r["pre"] <= x["pre"] <= r["pre_end"]) for r in rows}
    out = []

    def down(r):
        if any(links[c["pre"]] >= k for c in kids[r["pre"]]):
            for c in kids[r["pre"]]:
                down(c)
        else:
            out.append((r["pre"], r["pre_end"], links[r["pre"]]))

    for r in rows:
        if r["kind"] == "element" and r["tag"] == "body":
            down(r)
    return sorted(out)


def test_pagelets_of_random_pages(spark):
    rng = random.Random(8)
    pages = spark.createDataFrame([(i, random_page(rng) + random_page(rng)) for i in range(30)], "page_id long, html string")
    nodes = parse_pages(pages).cache()
    of = defaultdict(list)
    for r in nodes.orderBy("page_id", "pre").collect():
        of[r["page_id"]].append(r)
    for k in (1, 3):
        got = defaultdict(list)
        for r in L.pagelets(nodes, k).collect():
            got[r["page_id"]].append((r["pre"], r["pre_end"], r["links"]))
        assert {p: sorted(x) for p, x in got.items()} == {p: brute(rows, k) for p, rows in of.items()}
    sums = subtree_sums(nodes, {"n": L.F.lit(1), "d": L.F.col("depth")}).collect()
    for r in sums:
        own = next(x for x in of[r["page_id"]] if x["pre"] == r["pre"])
        inside = [x for x in of[r["page_id"]] if own["pre"] <= x["pre"] <= own["pre_end"]]
        assert (r["n"], r["d"]) == (len(inside), sum(x["depth"] for x in inside))


def test_two_templates_that_share_a_signature_are_told_apart(spark):
    """``div.box`` is a legal note on every page, a list of offers on four, and a page's own words elsewhere."""
    nav = "<ul>" + "".join(f"<li><a href='/{k}'>go {k}</a></li>" for k in range(4)) + "</ul>"
    note = "<div class='box'>All rights <b>reserved</b> by the owners of this site</div>"
    offer = "<div class='box'>Buy one and get   another one for free today</div>"
    html = [f"{nav}<div class='box'>page {i} says something of its own number {i} here</div>{offer if i < 4 else ''}{note}<div class='box'></div>" for i in range(6)]
    pages = spark.createDataFrame([(i, f"https://h{i // 6}.example/{i}", h) for i, h in enumerate(html)] + [(9, "https://other.example/", html[0]), (10, "not a url", html[0])], "page_id long, url string, html string")
    lets = L.sketched_pagelets(parse_pages(pages), pages).cache()
    got = {(r.host, r.pages, r.pagelets, r.selector) for r in L.templates(lets).collect()}
    assert got == {("h0.example", 6, 6, "ul"), ("h0.example", 6, 6, "div.box"), ("h0.example", 4, 4, "div.box")}
    of_first = sorted((r.selector, r.words) for r in lets.where("page_id = 0").collect())
    assert of_first == [("div.box", 0), ("div.box", 9), ("div.box", 9), ("div.box", 10), ("ul", 8)]


def test_sketches_look_at_shingles_not_at_positions(spark):
    rows = [(1, 0, i + 1, w) for i, w in enumerate("a b c d a b c d a b c d".split())] + [(2, 0, i + 1, w) for i, w in enumerate("a b c d a b c d".split())]
    rows += [(3, 0, i + 1, w) for i, w in enumerate("a b c".split())] + [(4, 0, i + 1, w) for i, w in enumerate("a b c".split())] + [(5, 0, i + 1, w) for i, w in enumerate("a c b".split())]
    got = {r.page_id: (r.words, r.sketch) for r in L.sketches(spark.createDataFrame(rows, "page_id long, let long, n int, word string")).collect()}
    assert got[1][1] == got[2][1] and got[1][0] == 12 and got[3] == got[4] and got[3][1] != got[5][1]
