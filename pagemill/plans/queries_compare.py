"""Comparison, sink, induction and streaming queries (registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import compare as K
from pagemill.operators import induce as I
from pagemill.operators import pagelets as L
from pagemill.operators.clean import clean_nodes
from pagemill.operators.nodes import node_table
from pagemill.plans.queries import register
from pagemill.plans.queries_presets import HEADING_SQL as _H1, site_presets
from pagemill.plans.queries_reader import GATE_SQL
from pagemill.session import checkpoint_dir, cut
from pagemill.sources.pages import parse_presets, read_page_json, read_pages, validate_pages, write_markdown, write_snapshots

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1))"


def _external(spark, sf_dir, pages):
    """What another service delivered: the document of a page's number as its
    markdown; for every fifth page nothing, for every third no html."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown"))
    made = pages.where("page_id % 5 != 0").join(docs, "page_id")
    return made.select("url", "markdown", F.when(F.col("page_id") % 3 != 0, F.col("html")).alias("html"))


def _results(spark, sf_dir):
    """Suggest (I2-I6), apply to the raw html, compare with the other methods."""
    pages = read_pages(spark, sf_dir)
    made = I.final_presets(I.induce(clean_nodes(pages), pages)).where("accepted")
    presets = cut(made.select("preset_id", "host", "priority", "preset_match_detectors", "main_content_selectors", "main_content_filters"))
    return pages, cut(K.method_results(pages, node_table(pages), presets, _external(spark, sf_dir, pages)))


_EXTERNAL_SQL = """
ext AS (
  SELECT p.page_id, p.url, d.doc_id IS NOT NULL AS has_markdown, d.text AS markdown, d.doc_id IS NOT NULL AND p.page_id % 3 <> 0 AS has_html
  FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id AND p.page_id % 5 <> 0
)"""
_EXTERNAL_ERROR = """nullif(concat_ws('; ', CASE WHEN NOT has_html THEN 'html missing' END, CASE WHEN NOT has_markdown THEN 'markdown missing' END), '')"""


@register("k3_method_results", f"""
WITH {_EXTERNAL_SQL}, gate AS ({GATE_SQL})
SELECT page_id, 'external' AS method, {_EXTERNAL_ERROR} AS error, has_markdown AND length(markdown) > 0 AS made FROM ext
UNION ALL SELECT page_id, 'preset', NULL, true FROM pages
UNION ALL SELECT page_id, 'literal', NULL, true FROM pages
UNION ALL SELECT page_id, 'reader', CASE WHEN NOT readable THEN 'Readability: not applicable' END, readable FROM gate
""")
def k3_method_results(spark, sf_dir):
    _, r = _results(spark, sf_dir)
    return r.select("page_id", "method", "error", F.coalesce(F.col("chars") > 0, F.lit(False)).alias("made"))


@register("k4_record", f"""
WITH {_EXTERNAL_SQL}
SELECT page_id, url, CAST(NULL AS VARCHAR) AS preset_error, {_EXTERNAL_ERROR} AS external_error,
       CASE WHEN length(markdown) > 0 THEN CAST(ceil(length(markdown) / 4.0) AS BIGINT) END AS external_tokens, has_html AS external_html
FROM ext
""")
def k4_record(spark, sf_dir):
    import uuid

    pages, r = _results(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    K.write_records(K.comparison_record(r), path)
    schema = ("page_id long, url string, preset STRUCT<markdown: string, error: string>, firecrawl STRUCT<markdown: string, error: string, html: string>, "
              "stats STRUCT<firecrawlMarkdown: STRUCT<chars: long, tokens: long>>")
    rec = spark.read.schema(schema).json(path)
    return rec.select("page_id", "url", F.col("preset.error").alias("preset_error"), F.col(f"{K.RECORD_KEYS['external']}.error").alias("external_error"),
                      F.col("stats.firecrawlMarkdown.tokens").alias("external_tokens"),
                      F.col(f"{K.RECORD_KEYS['external']}.html").isNotNull().alias("external_html"))


@register("k5_report")
def k5_report(spark, sf_dir):
    pages, r = _results(spark, sf_dir)
    return K.savings_report(r, pages)


@register("k5_raw_rollup", f"""
SELECT {_HOST} AS host, count(*) AS pages, CAST(sum(ceil(length(html) / 4.0)) AS BIGINT) AS raw_tokens
FROM pages GROUP BY ROLLUP ({_HOST})
""")
def k5_raw_rollup(spark, sf_dir):
    p = read_pages(spark, sf_dir).select(tx.url_host("url").alias("host"), tx.token_count("html").alias("t"))
    return p.rollup("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("t").cast("long").alias("raw_tokens"))


@register("s4_s6_snapshot_roundtrip", r"""
SELECT url, (regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AND length(html) >= 1) AS valid,
       CAST(length(html) AS BIGINT) AS chars FROM pages
""")
def s4_s6_snapshot_roundtrip(spark, sf_dir):
    import uuid

    pages = read_pages(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    write_snapshots(pages, path)
    back = read_page_json(spark, path)
    valid, rejects = validate_pages(back)
    return (valid.select("url", F.lit(True).alias("valid"), F.length("html").cast("long").alias("chars"))
            .unionByName(rejects.select("url", F.lit(False).alias("valid"), F.length("html").cast("long").alias("chars"))))


@register("i1_capped_clean_html")
def i1_capped_clean_html(spark, sf_dir):
    from pagemill.operators.clean import cleaned_html

    pages = read_pages(spark, sf_dir)
    c = cleaned_html(pages)
    return c.select("page_id", tx.utf16_len(tx.utf16_left("cleaned_html", tx.MAX_MODEL_HTML_CHARS)).alias("model_chars"),
                    "raw_chars", "clean_chars")


def _mined(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    cleaned = clean_nodes(pages)
    return pages, cleaned


@register("i2_support", f"""
WITH h AS (SELECT {_HOST} AS host, html FROM pages)
SELECT host, selector, CAST(count(*) AS BIGINT) AS pages_with FROM (
  SELECT host, 'nav' AS selector FROM h WHERE regexp_matches(html, '<nav\\b')
  UNION ALL SELECT host, 'footer' FROM h WHERE regexp_matches(html, '<footer\\b')
  UNION ALL SELECT host, 'article' FROM h WHERE regexp_matches(html, '<article\\b')
  UNION ALL SELECT host, 'div.ad' FROM h WHERE regexp_matches(html, '<div class="ad"')
  UNION ALL SELECT host, 'h1' FROM h WHERE regexp_matches(html, '<h1\\b')
) GROUP BY host, selector
""")
def i2_support(spark, sf_dir):
    pages, cleaned = _mined(spark, sf_dir)
    stats, _ = I.mine(cleaned, pages)
    return stats.where(F.col("selector").isin("nav", "footer", "article", "div.ad", "h1")).select(
        "host", "selector", F.col("pages_with").cast("long").alias("pages_with"))


@register("i2_signatures")
def i2_signatures(spark, sf_dir):
    """All (host, selector, tag) rows, of which i2_support and i2_nav_links show what their SQL can express."""
    pages, cleaned = _mined(spark, sf_dir)
    stats, _ = I.mine(cleaned, pages)
    return stats.select("host", "selector", "tag", *[F.col(c).cast("long").alias(c) for c in ("pages_with", "text_chars", "link_chars", "p_chars")], "support", "link_density")


@register("i2_nav_links", f"""
SELECT {_HOST} AS host,
       CAST(sum(list_sum(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1),
            lambda x: length(replace(x, '&amp;', '&'))))) AS BIGINT) AS link_chars
FROM pages GROUP BY 1
""")
def i2_nav_links(spark, sf_dir):
    pages, cleaned = _mined(spark, sf_dir)
    stats, _ = I.mine(cleaned, pages)
    return stats.where(F.col("selector") == "nav").select("host", F.col("link_chars").cast("long").alias("link_chars"))


@register("i2_paths")
def i2_paths(spark, sf_dir):
    """Every path of signatures of a host, so one signature in two places makes two rows."""
    pages, cleaned = _mined(spark, sf_dir)
    return I.path_stats(cleaned, pages)


@register("i2_repeats")
def i2_repeats(spark, sf_dir):
    pages, cleaned = _mined(spark, sf_dir)
    return I.repeats(cleaned, pages.select("page_id", tx.url_host("url").alias("host")), "host")


@register("i2_proposals", f"""
SELECT DISTINCT {_HOST} AS host, 'footer, nav' AS detectors, 'article' AS main, '' AS filters FROM pages
""")
def i2_proposals(spark, sf_dir):
    pages, cleaned = _mined(spark, sf_dir)
    _, presets = I.mine(cleaned, pages)
    return presets.select("host", F.array_join(F.array_sort("preset_match_detectors"), ", ").alias("detectors"),
                          F.array_join("main_content_selectors", ", ").alias("main"),
                          F.array_join("main_content_filters", ", ").alias("filters"))


@register("i3_i6_induction", f"""
SELECT {_HOST} AS host, 1 AS round, true AS accepted, count(*) AS pages, count(*) AS ok_pages, CAST(0 AS BIGINT) AS problems, count(*) AS md_pages
FROM pages GROUP BY 1
""")
def i3_i6_induction(spark, sf_dir):
    pages, cleaned = _mined(spark, sf_dir)
    att = I.induce(cleaned, pages)
    return I.final_presets(att).select("host", "round", "accepted", "pages", "ok_pages", "problems", "md_pages")


_ADX = """regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)"""
_NAVX, _ARTX = (f"regexp_extract(html, '(?s)<{t}>(.*?)</{t}>', 1)" for t in ("nav", "article"))


def _said(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"


@register("i2_pagelets", rf"""
WITH p AS (
  SELECT page_id, html, {_HOST} AS host, CAST(len(regexp_extract_all({_NAVX}, '<a href=')) AS BIGINT) AS links FROM pages
), l AS (
  SELECT page_id, host, 'ul' AS selector, links, {_said(_NAVX)} AS said FROM p WHERE links >= 3
  UNION ALL SELECT page_id, host, 'div.ad', 0, {_said(_ADX)} FROM p WHERE links >= 3
  UNION ALL SELECT page_id, host, 'article', 0, {_said(_ARTX)} FROM p WHERE links >= 3
  UNION ALL SELECT page_id, host, 'footer', 0, {_said("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} FROM p WHERE links >= 3
  UNION ALL SELECT page_id, host, 'body', links, {_said("regexp_extract(html, '(?s)<body>(.*)</body>', 1)")} FROM p WHERE links < 3
)
SELECT page_id, host, selector, links, CASE WHEN said = '' THEN 0 ELSE len(string_split(said, ' ')) END AS words FROM l
""")
def i2_pagelets(spark, sf_dir):
    """Every page's pagelets with what they link and say."""
    pages = read_pages(spark, sf_dir)
    return L.sketched_pagelets(node_table(pages), pages).select("page_id", "host", "selector", "links", "words")


@register("i2_templates")
def i2_templates(spark, sf_dir):
    """Pagelets that several pages of a host share, by sketch (no SQL: a sketch also joins texts that differ a little)."""
    pages = read_pages(spark, sf_dir)
    return L.templates(cut(L.sketched_pagelets(node_table(pages), pages)), least=2)


@register("t1_stream_serve", """
SELECT page_id, CASE WHEN page_id % 7 = 3 THEN 'queue' ELSE 'extract' END AS kind, CASE WHEN page_id % 7 <> 3 THEN 'ok' END AS status FROM pages
""")
def t1_stream_serve(spark, sf_dir):
    """Pages arrive as a stream; every seventh from a host that has no preset."""
    import uuid

    from pagemill.streaming.serve import serve

    base = f"{checkpoint_dir(spark).rstrip('/')}/serve-{uuid.uuid4().hex}"
    pages = read_pages(spark, sf_dir)
    moved = pages.withColumn("url", F.when(F.col("page_id") % 7 == 3, F.lit("https://new.example.net/p")).otherwise(F.col("url")))
    moved.write.parquet(f"{base}/in")
    q = serve(spark, f"{base}/in", site_presets(pages), f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    done = spark.read.parquet(f"{base}/out/extracts").select("page_id", F.lit("extract").alias("kind"), "status")
    return done.unionByName(spark.read.parquet(f"{base}/out/queue").select("page_id", F.lit("queue").alias("kind"), F.lit(None).cast("string").alias("status")))


@register("t1_stream_generate", rf"""
WITH p AS (
  SELECT page_id, html, page_id % 2 AS part, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS host FROM pages
), n AS (
  SELECT host, count(*) FILTER (WHERE part = 0) AS early, count(*) AS every FROM p GROUP BY host
)
SELECT page_id, CASE WHEN early >= 3 THEN part WHEN every >= 3 THEN 1 END AS served_in,
       CASE WHEN every >= 3 THEN {_H1} END AS heading
FROM p JOIN n USING (host)
""")
def t1_stream_generate(spark, sf_dir):
    """No presets at all: pages with even numbers arrive first. A host with three
    waiting pages gets presets; its later pages are served by them."""
    import uuid

    from pagemill.streaming.serve import serve

    base = f"{checkpoint_dir(spark).rstrip('/')}/generate-{uuid.uuid4().hex}"
    pages = read_pages(spark, sf_dir)
    for part in (0, 1):  # two files, the stream takes the older one first
        pages.where(F.col("page_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    serve(spark, f"{base}/in", None, f"{base}/out", f"{base}/ckpt", files_per_batch=1, enough=3).awaitTermination()
    done = spark.read.parquet(f"{base}/out/extracts")
    heading = F.regexp_extract("markdown", r"(?m)^(# .*)$", 1)
    return pages.select("page_id").join(done.select("page_id", F.col("batch_id").cast("long").alias("served_in"), heading.alias("heading")), "page_id", "left")


# ---- S2, S4, F11, F12 over the pages' URLs ----------------------------------

@register("s2_presets", """
SELECT page_id, page_id % 5 = 0 AS valid FROM pages
""")
def s2_presets(spark, sf_dir):
    """A preset document for each page; by its number it is right, has one key
    too many, no detectors, an empty selector, or a key too few."""
    pages = read_pages(spark, sf_dir).select("page_id", "url")
    some = F.array(F.lit("nav"), F.concat(F.lit("#p"), F.col("page_id").cast("string")))
    none = F.array().cast("array<string>")
    good = (some.alias("preset_match_detectors"), some.alias("main_content_selectors"), none.alias("main_content_filters"))
    kinds = [F.to_json(F.struct(*good)), F.to_json(F.struct(*good, F.col("url").alias("note"))),
             F.to_json(F.struct(none.alias("preset_match_detectors"), *good[1:])),
             F.to_json(F.struct(good[0], F.array(F.lit("")).alias("main_content_selectors"), good[2])), F.to_json(F.struct(*good[:2]))]
    doc = F.element_at(F.array(*kinds), (F.col("page_id") % 5 + 1).cast("int"))
    presets, rejects = parse_presets(pages.select("page_id", doc.alias("json")))
    return presets.select("page_id", F.lit(True).alias("valid")).unionByName(rejects.select("page_id", F.lit(False).alias("valid")))


_SLUG = r"substr(regexp_replace(regexp_replace(regexp_replace(url, '^(?i)[a-z]+://', ''), '(?i)[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120)"


@register("f11_f12_names", rf"""
SELECT page_id, {_SLUG} AS slug, substr(lower(regexp_replace(url, '(?i)[^a-z0-9]', '.', 'g')), 1, 200) AS safe_name FROM pages
""")
def f11_f12_names(spark, sf_dir):
    return read_pages(spark, sf_dir).select("page_id", tx.slugify("url").alias("slug"), tx.safe_name("url").alias("safe_name"))


@register("s4_markdown_sink", rf"""
SELECT {_SLUG} AS slug, url, CAST(length(text) AS BIGINT) AS chars
FROM pages JOIN documents ON doc_id = page_id WHERE length(text) > 0
""")
def s4_markdown_sink(spark, sf_dir):
    import uuid

    pages = read_pages(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/markdown-{uuid.uuid4().hex}"
    write_markdown(pages.join(docs, "page_id"), path)
    return spark.read.parquet(path).select("slug", "url", tx.utf16_len("markdown").cast("long").alias("chars"))
