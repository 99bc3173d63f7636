"""Work that has to grow no faster than the pages: buckets, tables read several times, presets that are not chosen."""
import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.operators import markdown, presets, selectors
from pagemill.operators.nodes import node_table
from pagemill.sources.pages import presets_frame
from pagemill.streaming.serve import extract_batch

from helpers import pages_df

HTML = "<body><nav><a href='/x'>x</a></nav><article><h1>T</h1><p>one <b>two</b></p></article></body>"


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.fixture
def nodes(spark):
    return node_table(pages_df(spark, [HTML, HTML + "<p>more"]))


def test_buckets_grow_with_the_pages(spark):
    with session.scratch(spark):
        session.plan_buckets(spark.range(30_000_000))  # 240 MB by its statistics; nothing is read
        assert session.buckets_of(spark) >= 70
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false"


def test_a_step_has_as_many_tasks_as_there_are_buckets(spark, nodes):
    mark = nodes.select("page_id", F.lit("s").alias("selector"), F.lit(0).alias("alt_no"), *selectors._POS)
    here = mark.withColumns({"n_steps": F.lit(2), "comb": F.lit(" "), "pos": F.lit(None).cast("array<struct<name:string,n:int>>")})
    spark.conf.set(session._BUCKETS, "13")
    try:
        out = selectors._next_step(mark, here, ["page_id", "selector", "alt_no"], [" "])
        assert "RepartitionByExpression [page_id" in plan(out) and ", 13" in plan(out)
    finally:
        spark.conf.unset(session._BUCKETS)


def test_blocks_are_worked_out_once(nodes):
    md = markdown.render(nodes)
    assert "pagemill_blocks" in plan(md) and "regexp_replace(raw" not in plan(md)
    assert md.orderBy("page_id").first().markdown == "[x](/x)\n\n# T\n\none **two**\n"


def test_schemes_of_urls(spark):
    urls = ["http://a", "HTTPS:b", "ftp://c", "java\nscript:d", "  mailto:e ", "/f:g", "?h:i", "#j:k", ":l", "", "m", "httpx:n", "h:ttp:", "irc\n", "o\np:q", None]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", markdown._url(F.col("u"), markdown.LINK_SCHEMES).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["http://a", "HTTPS:b", "", "", "mailto:e", "/f:g", "?h:i", "#j:k", ":l", "", "m", "", "", "irc", "", ""]


PRESETS = [{"preset_id": 1, "host": "example.com", "priority": 2, "preset_match_detectors": ["nav"], "main_content_selectors": ["article"], "main_content_filters": ["h1"]},
           {"preset_id": 2, "host": "example.com", "priority": 1, "preset_match_detectors": ["nav"], "main_content_selectors": ["p"]}]


def test_only_chosen_presets_are_extracted_and_only_their_pages_parsed(spark, monkeypatch):
    import pagemill.streaming.serve as serve

    parsed, rendered = [], []
    monkeypatch.setattr(serve, "node_table", lambda p: parsed.append(p.count()) or node_table(p))
    monkeypatch.setattr(serve, "render", lambda d, keys: rendered.append(d.select("page_id", "preset_id").distinct().collect()) or markdown.render(d, keys))
    pages = pages_df(spark, [HTML, HTML, HTML], ["https://example.com/a", "https://other.net/b", "https://example.com/c"])
    extracts, queue = extract_batch(pages, presets_frame(spark, PRESETS))
    assert {(r.page_id, r.preset_id, r.markdown) for r in extracts.collect()} == {(0, 2, "one **two**\n"), (2, 2, "one **two**\n")}
    assert [r.page_id for r in queue.collect()] == [1]
    assert parsed == [2] and {(r.page_id, r.preset_id) for r in rendered[0]} == {(0, 2), (2, 2)}


def test_page_tables_are_not_broadcast(spark):
    """Tables that grow with the pages are merged, however few bytes their files take."""
    from pagemill.operators.nodes import node_table
    from pagemill.operators import presets as P
    from pagemill.sources.pages import presets_frame

    pages = spark.createDataFrame([(i, "http://a.example/x", "<nav>n</nav><article><h1>t</h1><p>x</p></article>") for i in range(40)], "page_id long, url string, html string")
    presets = presets_frame(spark, [{"host": "a.example", "preset_match_detectors": ["nav"], "main_content_selectors": ["article", "article p"], "main_content_filters": ["h1:nth-child(1)", ".no"]}])
    run = P.run_presets(node_table(pages), pages, presets)
    chosen, _ = P.choose_preset(run, pages)
    for r in (run, P.only_pairs(run, chosen)):
        status = P.apply_status(r)
        for found in (P.problems(r), status, P._role_matches(r, "main").join(status.where("status = 'ok'"), ["page_id", "preset_id"], "left_semi")):
            assert "BroadcastHashJoin" not in plan(found, "sparkPlan")
    assert P.feedback(run).where("feedback LIKE '%.no%' AND feedback LIKE '%article → article p%' AND feedback LIKE '%nth-child(1)%'").count() == 40


def test_open_marks_are_counted_in_one_window(spark, nodes):
    """One sort of the nodes for all marks; a page's densities are read, not worked out, for their parents."""
    from pagemill.operators import reader, structure

    tagged = lambda t: (F.col("kind") == "element") & (F.col("tag") == t)
    counted = structure.open_counts(nodes, {"_b": (tagged("body"), False), "_p": (tagged("p"), True), "_a": (tagged("a"), False)})
    assert plan(counted, "sparkPlan").count("Window [") == 1
    assert [(r._b, r._p, r._a) for r in counted.where("page_id = 1 AND kind = 'text'").orderBy("pre").collect()] == [(1, 0, 1), (1, 0, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0)]
    assert plan(markdown.prepare(nodes), "sparkPlan").count("Window [") == 2
    told = plan(reader.densities(nodes), "sparkPlan")
    assert told.count("pagemill_density") == 2 and "pagemill_nodes" not in told
