"""End-to-end: batch = stream for serving, comparison record shape, induction."""

import os
import tempfile

from pyspark.sql import functions as F

from pagemill.operators import compare as K
from pagemill.operators import induce as I
from pagemill.operators.clean import clean_nodes
from pagemill.operators.nodes import parse_pages
from pagemill.plans.queries_presets import site_presets
from pagemill.sources.pages import read_pages
from pagemill.streaming.serve import extract_batch, serve

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    pages = read_pages(spark, SF)
    presets = site_presets(pages)
    batch, queue = extract_batch(pages, presets)
    base = tempfile.mkdtemp(prefix="serve-", dir="/tmp")
    q = serve(spark, SF, presets, os.path.join(base, "out"), os.path.join(base, "ckpt"), glob="pages.parquet")
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(base, "out", "extracts")).drop("batch_id")
    cols = ["page_id", "preset_id", "status", "markdown"]
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())
    assert queue.count() == 0


def test_comparison_record(spark):
    pages = read_pages(spark, SF).where(F.col("page_id") < 5)
    nodes = parse_pages(pages).repartition("page_id")
    res = K.method_results(pages, nodes, site_presets(pages))
    rows = {(r["page_id"], r["method"]): r for r in res.collect()}
    assert all(rows[(p, "external")]["error"] == "html missing; markdown missing" for p in range(5))
    assert all(rows[(p, "literal")]["markdown"] for p in range(5))
    assert all(rows[(p, "preset")]["error"] is None for p in range(5))
    rec = K.comparison_record(res).collect()
    assert len(rec) == 5 and rec[0]["stats"]["literalMarkdown"]["tokens"] > 0
    lit, pre = rows[(0, "literal")], rows[(0, "preset")]
    assert pre["tokens"] < lit["tokens"]  # the preset keeps the article only


def test_induction_proposes_layout_and_article(spark):
    pages = read_pages(spark, SF)
    cleaned = clean_nodes(pages).repartition("page_id")
    _, presets = I.mine(cleaned, pages)
    p = presets.collect()
    assert all(sorted(r["preset_match_detectors"]) == ["footer", "nav"] for r in p)
    assert all(r["main_content_selectors"] == ["article"] for r in p)
    att = I.induce(cleaned, pages, max_rounds=2)
    fin = I.final_presets(att).collect()
    assert len(fin) == len(p) and all(r["accepted"] for r in fin)


def test_a_few_odd_pages_do_not_undo_good_selectors(spark):
    """Ten pages of one host: the box on seven of them and the nav on nine stay in the preset."""
    body = "<article><h1>t</h1>{ad}<p>" + "word " * 60 + "</p><p>more words here</p></article><footer>end</footer>"
    html = [("" if i == 9 else "<nav><a href='/'>home</a></nav>") + body.format(ad='<div class="ad-box">buy</div>' if i < 7 else "") for i in range(10)]
    pages = spark.createDataFrame([(i, f"https://one.example.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    fin = I.final_presets(I.induce(clean_nodes(pages), pages)).collect()
    assert len(fin) == 1 and fin[0]["accepted"] and fin[0]["ok_pages"] == 9
    assert sorted(fin[0]["preset_match_detectors"]) == ["footer", "nav"]
    assert fin[0]["main_content_filters"] == ["div.ad-box"]


def test_each_layout_of_a_host_gets_its_preset(spark):
    """Six pages of one layout, four of another, in a common box; one detector more than three, missed now and then."""
    text = "<p>" + "word " * 60 + "</p><p>more words here</p>"
    heads = "<header>h</header><nav><a href='/'>home</a></nav><div class='topbar'>top</div><aside class='side'>s</aside>"
    one = "<div id='page'>" + heads + "<article><h1>t</h1>" + text + "</article><footer>end</footer></div>"
    two = "<div id='page'>" + heads + "<div class='post'><h1>t</h1>" + text + "</div><footer>end</footer></div>"
    pages = spark.createDataFrame([(i, f"https://one.example.com/{i}", one if i < 6 else two) for i in range(10)], "page_id long, url string, html string")
    fin = I.final_presets(I.induce(clean_nodes(pages), pages))
    rows = {r["main_content_selectors"][0]: r for r in fin.collect()}
    assert {m: (r["accepted"], r["pages"], r["ok_pages"]) for m, r in rows.items()} == {"article": (True, 6, 6), "div.post": (True, 4, 4)}
    assert all(set(r["preset_match_detectors"]) >= {"header", "nav", "div.topbar", "aside.side", "footer", m} for m, r in rows.items())
    presets = fin.where("accepted").select("preset_id", "host", "priority", "preset_match_detectors", "main_content_selectors", "main_content_filters")
    res = {r["page_id"]: r for r in K.method_results(pages, parse_pages(pages).repartition("page_id"), presets).where("method = 'preset'").collect()}
    assert len(res) == 10 and all(r["error"] is None and "more words here" in r["markdown"] and "home" not in r["markdown"] for r in res.values())


def test_detectors_that_together_miss_too_many_pages_are_dropped(spark):
    """Four layout elements, each missing on another tenth of the pages: all four are there on six of ten."""
    parts = ["<header>h</header>", "<nav><a href='/'>home</a></nav>", "<aside>s</aside>", "<footer>end</footer>"]
    body = "<article><h1>t</h1><p>" + "word " * 60 + "</p><p>more words here</p></article>"
    html = ["".join(x for k, x in enumerate(parts) if k != i) + body for i in range(10)]
    pages = spark.createDataFrame([(i, f"https://one.example.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    fin = I.final_presets(I.induce(clean_nodes(pages), pages)).collect()
    assert len(fin) == 1 and fin[0]["accepted"] and fin[0]["ok_pages"] == 8 and len(fin[0]["preset_match_detectors"]) == 2


def repeating_pages(spark):
    note = "<div class='fine'><p>All rights</p> <p>are   reserved.</p></div>"
    html = ["<nav><a href='/'>home</a></nav><article><h2 class='s'>Contents</h2><p class='t'>" + f"word{i} " * 60 + f"</p>{note}<p>more words {i}</p></article>" for i in range(6)]
    return spark.createDataFrame([(i, f"https://one.example.com/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_text_repeated_across_pages_is_filtered(spark):
    from pagemill.functions.text import url_host

    pages = repeating_pages(spark)
    cleaned = clean_nodes(pages)
    got = I.repeats(cleaned, pages.select("page_id", url_host("url").alias("host")), "host").collect()
    assert {(r["selector"], r["elements"], r["repeated"], r["repeated_text_ratio"]) for r in got} == {
        ("nav", 6, 6, 1.0), ("a", 6, 6, 1.0), ("article", 6, 0, 0.0), ("h2.s", 6, 6, 1.0), ("p.t", 6, 0, 0.0), ("div.fine", 6, 6, 1.0), ("p", 18, 12, 12 / 18)}
    _, presets = I.mine(cleaned, pages)
    assert [r["main_content_filters"] for r in presets.collect()] == [["div.fine"]]


def test_proposer_is_asked_each_round_and_told_what_came_out(spark):
    import pandas as pd

    def proposer(pdf: pd.DataFrame) -> pd.DataFrame:
        good = ["Main content selectors matched nothing: div.none" in f for f in pdf["feedback"]]
        return pd.DataFrame([{"preset_id": 7 + g, "host": h, "priority": 0, "preset_match_detectors": ["nav"],
                              "main_content_selectors": ["article" if g else "div.none"], "main_content_filters": []} for h, g in zip(pdf["host"], good)])

    pages = repeating_pages(spark)
    rows = sorted(I.induce(clean_nodes(pages), pages, max_rounds=3, proposer=proposer).collect(), key=lambda r: r["round"])
    assert [(r["round"], r["accepted"], r["ok_pages"]) for r in rows] == [(1, False, 0), (2, True, 6)]
    assert rows[1]["feedback"].startswith("\n\nExtraction preview (markdown):\n") and "more words 0" in rows[1]["feedback"]


def test_proposer_hook_sees_all_pages_of_a_host(spark):
    import pandas as pd

    def proposer(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"preset_id": 7, "host": h, "priority": 0, "preset_match_detectors": ["nav"],
                              "main_content_selectors": ["article" if "<p>" in x else "body"], "main_content_filters": ["h1"]}
                             for h, x in zip(pdf["host"], pdf["html"])])

    pages = read_pages(spark, SF)
    out = I.propose_with(pages, proposer).collect()
    hosts = pages.select(F.lower(F.expr("parse_url(url, 'HOST')")).alias("h")).distinct().count()
    assert len(out) == hosts and all(r["main_content_selectors"] == ["article"] for r in out)


def test_markdown_sink_partitioned(spark):
    from pagemill.operators.markdown import html_to_markdown
    from pagemill.sources.pages import write_markdown

    pages = read_pages(spark, SF)
    md = html_to_markdown(pages.select("page_id", "html")).join(pages.select("page_id", "url"), "page_id")
    path = tempfile.mkdtemp(prefix="md-sink-", dir="/tmp")
    write_markdown(md, path)
    back = spark.read.parquet(path)
    assert back.count() == pages.count()
    assert "host_bucket" in back.columns and back.where(F.length("slug") == 0).count() == 0
