"""S1, S2 validation and scalar functions."""

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.sources.pages import parse_presets, validate_pages


def test_validate_pages(spark):
    df = spark.createDataFrame([(0, "https://a.com/x", "<p>x</p>"), (1, "not a url", "<p>x</p>"), (2, "mailto:x@y.z", "h"),
                                (3, "https://a.com", ""), (4, None, "h")], "page_id long, url string, html string")
    valid, rejects = validate_pages(df)
    assert sorted(r["page_id"] for r in valid.collect()) == [0, 2]
    assert {r["page_id"]: r["reason"] for r in rejects.collect()} == {1: "invalid_url", 3: "empty_html", 4: "invalid_url"}


def test_parse_presets_strict(spark):
    good = '{"preset_match_detectors":["nav"],"main_content_selectors":["article"],"main_content_filters":[]}'
    extra = '{"preset_match_detectors":["nav"],"main_content_selectors":["article"],"main_content_filters":[],"x":1}'
    empty_main = '{"preset_match_detectors":["nav"],"main_content_selectors":[],"main_content_filters":[]}'
    empty_sel = '{"preset_match_detectors":[""],"main_content_selectors":["a"],"main_content_filters":[]}'
    missing = '{"preset_match_detectors":["nav"],"main_content_selectors":["a"]}'
    df = spark.createDataFrame([(i, j) for i, j in enumerate([good, extra, empty_main, empty_sel, missing])], "id long, json string")
    presets, rejects = parse_presets(df)
    assert [r["id"] for r in presets.collect()] == [0]
    assert sorted(r["id"] for r in rejects.collect()) == [1, 2, 3, 4]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("https://Example.com/a b?x=1#y", "a\U0001F600b" * 70)], "url string, t string")
    r = df.select(tx.slugify("url").alias("slug"), tx.safe_name("url").alias("safe"), tx.utf16_len("t").alias("n"),
                  tx.utf16_left("t", 2).alias("l2"), tx.utf16_left("t", 3).alias("l3"), tx.token_count("t").alias("tok"),
                  tx.char_count(F.lit("")).alias("empty"), tx.join_nonempty("\n", F.lit("a"), F.lit(""), F.lit("b")).alias("j"),
                  tx.escape_text(F.lit("<a&b>")).alias("esc")).collect()[0]
    assert r["slug"] == "Example-com-a-b-x-1-y"
    assert r["safe"] == "https...example.com.a.b.x.1.y"
    assert r["n"] == 280 and r["tok"] == 70
    assert r["l2"] == "a" and r["l3"] == "a\U0001F600"  # never split a surrogate pair
    assert r["empty"] is None and r["j"] == "a\nb" and r["esc"] == "&lt;a&amp;b&gt;"
