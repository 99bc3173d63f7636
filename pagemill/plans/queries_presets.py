"""Selector, preset and markdown queries (registered on import).

Presets are per host: a short template list is exploded over the distinct
hosts of ``pages``, so every page is validated against its host's presets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import presets as P
from pagemill.operators.markdown import html_to_markdown, render
from pagemill.operators.nodes import node_table
from pagemill.operators.selectors import compile_selectors, select, select_nodes
from pagemill.plans.queries import register
from pagemill.sources.pages import read_pages

# Preset templates used by the queries: (preset_id, priority, detectors, main, filters).
TEMPLATES = [
    (0, 1, ["nav", "footer"], ["article"], ["h1"]),
    (1, 0, [".nav"], ["#content"], []),
    (2, 2, ["nav"], ["article", ".ad"], [".ad", "div:contains("]),
    (3, 3, ["nav ul", "footer"], ["article", "article > p", "article h1"], [".ad", "h1", "li:nth-child(2)"]),
]


def site_presets(pages):
    hosts = pages.select(tx.url_host("url").alias("host")).distinct()
    tpl = F.array(*[F.struct(F.lit(i).cast("long").alias("preset_id"), F.lit(pr).alias("priority"),
                             F.array(*[F.lit(x) for x in d]).alias("preset_match_detectors"),
                             F.array(*[F.lit(x) for x in m]).alias("main_content_selectors"),
                             F.array(*[F.lit(x) for x in f]).cast("array<string>").alias("main_content_filters"))
                    for i, pr, d, m, f in TEMPLATES])
    return hosts.select("host", F.explode(tpl).alias("t")).select("t.preset_id", "host", "t.priority",
                                                                   "t.preset_match_detectors", "t.main_content_selectors",
                                                                   "t.main_content_filters")


def _run(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    nodes = node_table(pages)
    return P.run_presets(nodes, pages, site_presets(pages)), nodes, pages


_ART = r"regexp_extract(html, '(?is)<article>(.*?)</article>', 1)"
_NAV = r"regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1)"
_DEC = "replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"
_TPL_VALUES = "(VALUES (0), (1), (2), (3)) t(preset_id)"


# ---- P1 -------------------------------------------------------------------

P1_SELECTORS = ["nav", "article", ".ad", "nav li > a", "article > p", "li:first-child", 'a[href^="/t"]', "footer",
                "h1 ~ p", "div.ad + article", "ul a", "body > *"]


@register("p1_select", rf"""
WITH c AS (
  SELECT page_id, 'nav' AS selector, len(regexp_extract_all(html, '<nav\b')) AS hits FROM pages
  UNION ALL SELECT page_id, 'article', len(regexp_extract_all(html, '<article\b')) FROM pages
  UNION ALL SELECT page_id, '.ad', len(regexp_extract_all(html, 'class="ad"')) FROM pages
  UNION ALL SELECT page_id, 'nav li > a', len(regexp_extract_all({_NAV}, '<a\b')) FROM pages
  UNION ALL SELECT page_id, 'article > p', len(regexp_extract_all({_ART}, '<p\b')) FROM pages
  UNION ALL SELECT page_id, 'li:first-child', CASE WHEN regexp_matches(html, '<ul><li') THEN 1 ELSE 0 END FROM pages
  UNION ALL SELECT page_id, 'a[href^="/t"]', len(regexp_extract_all(html, '<a href="/t')) FROM pages
  UNION ALL SELECT page_id, 'footer', len(regexp_extract_all(html, '<footer\b')) FROM pages
  UNION ALL SELECT page_id, 'h1 ~ p', len(regexp_extract_all({_ART}, '<p\b')) FROM pages
  UNION ALL SELECT page_id, 'div.ad + article', CASE WHEN regexp_matches(html, '(?s)<div class="ad">[^<]*</div><article') THEN 1 ELSE 0 END FROM pages
  UNION ALL SELECT page_id, 'ul a', len(regexp_extract_all({_NAV}, '<a\b')) FROM pages
  UNION ALL SELECT page_id, 'body > *', 4 FROM pages
)
SELECT page_id, selector, CAST(hits AS BIGINT) AS hits FROM c WHERE hits > 0
""")
def p1_select(spark, sf_dir):
    nodes = node_table(read_pages(spark, sf_dir))
    m = select(nodes, P1_SELECTORS)
    return m.groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("hits"))


#: Selectors with others inside and with positions; those of links also tell the first match's text.
P1_RELATIONS = ["article:has(> p)", "body > :is(nav, footer) a", "li:eq(1) > a", "li:last a", "li:gt(2)", "li:not(:has(+ li))", "li:not(li + li) a", "p:first", "ul:has(> li ~ li)",
                "nav:not(:has(article)) > ul:has(a) li:odd", "article:is(nav ~ *):has(h1 + p)", "li:has(ul)"]


@register("p1_relations", rf"""
WITH p AS (
  SELECT page_id, len(regexp_extract_all({_ART}, '<p\b')) AS p, regexp_matches(html, '(?s)</h1><p') AS h1p,
         regexp_extract_all({_NAV}, '<a href="[^"]*">([^<]*)</a>', 1) AS a FROM pages
), c AS (
  SELECT page_id, 'article:has(> p)' AS selector, CAST(p > 0 AS INTEGER) AS hits, NULL AS text FROM p
  UNION ALL SELECT page_id, 'body > :is(nav, footer) a', len(a), a[1] FROM p
  UNION ALL SELECT page_id, 'li:eq(1) > a', CAST(len(a) > 1 AS INTEGER), a[2] FROM p
  UNION ALL SELECT page_id, 'li:last a', CAST(len(a) > 0 AS INTEGER), a[-1] FROM p
  UNION ALL SELECT page_id, 'li:gt(2)', greatest(len(a) - 3, 0), NULL FROM p
  UNION ALL SELECT page_id, 'li:not(:has(+ li))', CAST(len(a) > 0 AS INTEGER), NULL FROM p
  UNION ALL SELECT page_id, 'li:not(li + li) a', CAST(len(a) > 0 AS INTEGER), a[1] FROM p
  UNION ALL SELECT page_id, 'p:first', CAST(p > 0 AS INTEGER), NULL FROM p
  UNION ALL SELECT page_id, 'ul:has(> li ~ li)', CAST(len(a) > 1 AS INTEGER), NULL FROM p
  UNION ALL SELECT page_id, 'nav:not(:has(article)) > ul:has(a) li:odd', len(a) // 2, NULL FROM p
  UNION ALL SELECT page_id, 'article:is(nav ~ *):has(h1 + p)', CAST(h1p AS INTEGER), NULL FROM p
)
SELECT page_id, selector, CAST(hits AS BIGINT) AS hits, {_DEC.format(x='text')} AS text FROM c WHERE hits > 0
""")
def p1_relations(spark, sf_dir):
    """Selectors as presets use them: demanded for each page."""
    pages = read_pages(spark, sf_dir)
    nodes = node_table(pages)
    demand = pages.select("page_id", F.explode(F.array(*[F.lit(x) for x in P1_RELATIONS])).alias("selector"))
    steps, _ = compile_selectors(demand.select("selector"))
    m = select_nodes(nodes, steps, demand=demand).groupBy("page_id", "selector").agg(F.count(F.lit(1)).alias("hits"), F.min("pre").alias("parent"))
    texts = nodes.where("kind = 'text'").groupBy("page_id", "parent").agg(F.min_by("text", "pre").alias("text"))
    told = F.when(F.col("selector").rlike(r"\ba$"), F.col("text"))
    return m.join(texts, ["page_id", "parent"], "left").select("page_id", "selector", "hits", told.alias("text"))


# ---- P3 ---------------------------------------------------------------------

@register("p3_critical", rf"""
SELECT page_id, preset_id, problem_no, type, selectors FROM (
  SELECT page_id, 1 AS preset_id, 1 AS problem_no, 'preset_match_detectors_did_not_hit_any_node' AS type, '.nav' AS selectors FROM pages
  UNION ALL SELECT page_id, 1, 2, 'main_content_selectors_failed', '#content' FROM pages
  UNION ALL SELECT page_id, 2, 0, 'invalid_selectors_detected', 'div:contains(' FROM pages
)
""")
def p3_critical(spark, sf_dir):
    run, _, _ = _run(spark, sf_dir)
    return P.critical_problems(run).select("page_id", "preset_id", "problem_no", "type",
                                           F.array_join("selectors", ", ").alias("selectors"))


# ---- P4-P7 -------------------------------------------------------------------

@register("p4_p7_noncritical", rf"""
SELECT page_id, 3 AS preset_id, 3 AS problem_no, 'main_content_filters_do_not_apply_to_main_content' AS type,
       '.ad, li:nth-child(2)' AS detail FROM pages
UNION ALL SELECT page_id, 3, 4, 'nth_child_selectors_detected', 'li:nth-child(2)' FROM pages
UNION ALL SELECT page_id, 3, 6, 'nested_selectors_detected_in_main_content_selectors',
       CASE WHEN regexp_matches({_ART}, '<p\b') THEN 'article → article > p; article → article h1'
            ELSE 'article → article h1' END FROM pages
""")
def p4_p7_noncritical(spark, sf_dir):
    run, _, _ = _run(spark, sf_dir)
    nc = P.noncritical_problems(run)
    detail = F.when(F.col("type") == P.NESTED, F.array_join(
        F.transform("relations", lambda r: F.concat(r["outer"], F.lit(P.RELATION_ARROW), r["inner"])), "; ")
    ).otherwise(F.array_join("selectors", ", "))
    return nc.select("page_id", "preset_id", "problem_no", "type", detail.alias("detail"))


# ---- P8 ------------------------------------------------------------------------

_FB3 = ("Please fix the following issues in your next attempt:\n"
        "- These filters do not match within the selected main content: .ad, li:nth-child(2). "
        "Remove them or scope them to elements inside the main content.\n"
        "- Avoid nth-child/of-type in these selectors: li:nth-child(2). The DOM structure can change; "
        "prefer stable attributes or classes.\n"
        "- Some main content selectors are nested within others: article → article > p; article → article h1. "
        "Use a single parent-level selector to avoid duplication and brittleness.")
_FB1 = ("Please fix the following issues in your next attempt:\n"
        "- These preset match selectors matched nothing: .nav. Choose stable site-wide elements (e.g., header, nav, footer) "
        "that exist across pages.\n"
        "- These main content selectors matched nothing: #content. Target the container that holds the readable article "
        "or body content.")
_FB2 = ("Please fix the following issues in your next attempt:\n"
        "- These selectors are syntactically invalid or unsupported: div:contains(. Fix unmatched parentheses, typos, "
        "or remove unsupported pseudo-selectors.")


@register("p8_feedback", f"""
SELECT page_id, preset_id,
       CASE preset_id WHEN 0 THEN '' WHEN 1 THEN '{_FB1}' WHEN 2 THEN '{_FB2}' ELSE '{_FB3}' END AS feedback
FROM pages, {_TPL_VALUES}
""")
def p8_feedback(spark, sf_dir):
    run, _, _ = _run(spark, sf_dir)
    return P.feedback(run)


# ---- P9 ----------------------------------------------------------------------

@register("p9_apply_text", rf"""
SELECT page_id, preset_id,
       CASE preset_id WHEN 1 THEN 'preset_match_detectors_failed' WHEN 2 THEN 'invalid_selectors_failed' ELSE 'ok' END AS status,
       CASE preset_id WHEN 1 THEN '.nav' WHEN 2 THEN 'div:contains(' ELSE '' END AS failed,
       CAST(CASE preset_id WHEN 0 THEN chars WHEN 3 THEN 2 * chars + paragraphs + 1 END AS BIGINT) AS text_chars
FROM (
  SELECT page_id, len(regexp_extract_all({_ART}, '<p\b')) AS paragraphs,
         coalesce(list_sum(list_transform(regexp_extract_all(regexp_replace({_ART}, '(?s)<h1>.*?</h1>', '', 'g'), '(?:^|>)([^<]+)', 1),
              lambda x: length({_DEC.format(x='x')}))), 0) AS chars
  FROM pages
), {_TPL_VALUES}
""")
def p9_apply_text(spark, sf_dir):
    run, nodes, _ = _run(spark, sf_dir)
    res, doc = P.apply_presets(run, nodes)
    chars = doc.where(F.col("kind") == "text").groupBy("page_id", "preset_id").agg(
        F.sum(tx.utf16_len("text")).cast("long").alias("text_chars"))
    out = res.join(chars, ["page_id", "preset_id"], "left")
    return out.select("page_id", "preset_id", "status", F.array_join("failed_selectors", ", ").alias("failed"),
                      F.when(F.col("status") == "ok", F.coalesce("text_chars", F.lit(0)).cast("long")).alias("text_chars"))


# ---- P10 / P11 ------------------------------------------------------------------

CRYPTIC_TEMPLATE = (9, 9, ["nav", ".xQ7vLp2RwZt9KdMn4Bsy"], ["#story-48213", ".lead-text"], [])


@register("p10_cryptic", r"""
SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS host, CAST(9 AS BIGINT) AS preset_id,
       'cryptic_selectors_detected' AS type, '.xQ7vLp2RwZt9KdMn4Bsy, #story-48213' AS selectors
FROM pages
""")
def p10_cryptic(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    i, pr, d, m, f = CRYPTIC_TEMPLATE
    extra = (pages.select(tx.url_host("url").alias("host")).distinct()
             .select(F.lit(i).cast("long").alias("preset_id"), "host", F.lit(pr).alias("priority"),
                     F.array(*[F.lit(x) for x in d]).alias("preset_match_detectors"),
                     F.array(*[F.lit(x) for x in m]).alias("main_content_selectors"),
                     F.array().cast("array<string>").alias("main_content_filters")))
    presets = site_presets(pages).unionByName(extra)
    run = P.PresetRun(None, None, None, P.preset_selectors(presets), None)
    return (P.cryptic_selectors(run)
            .select("host", "preset_id", "type", F.array_join("selectors", ", ").alias("selectors")))


@register("p11_choose", "SELECT page_id, CAST(0 AS BIGINT) AS preset_id FROM pages")
def p11_choose(spark, sf_dir):
    run, _, pages = _run(spark, sf_dir)
    chosen, _ = P.choose_preset(run, pages)
    return chosen


# ---- Markdown -----------------------------------------------------------------

def _literal(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    return html_to_markdown(pages.select("page_id", "html"))


_ESC = r"regexp_replace({x}, '([\\*_`\[])', '\\\1', 'g')"


HEADING_SQL = "'# ' || " + _ESC.format(x="regexp_replace(trim(" + _DEC.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + r"), '\s+', ' ', 'g')")


@register("m4_headings", f"SELECT page_id, {HEADING_SQL} AS heading FROM pages")
def m4_headings(spark, sf_dir):
    md = _literal(spark, sf_dir)
    lines = md.select("page_id", F.explode(F.split("markdown", "\n")).alias("heading"))
    return lines.where(F.col("heading").rlike(r"^#{1,6} "))


@register("m7_nav_items", rf"""
SELECT page_id, CAST(item_no AS INTEGER) AS item_no, '- [' || {_ESC.format(x=_DEC.format(x='t[2]'))} || '](' || t[1] || ')' AS line
FROM (
  SELECT page_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS item_no FROM (
    SELECT page_id, list_zip(regexp_extract_all({_NAV}, '<a href="([^"]*)">', 1),
                             regexp_extract_all({_NAV}, '<a href="[^"]*">([^<]*)</a>', 1)) AS a FROM pages)
)
""")
def m7_nav_items(spark, sf_dir):
    md = _literal(spark, sf_dir)
    items = md.select("page_id", F.filter(F.split("markdown", "\n"), lambda s: s.startswith("- [")).alias("a"))
    return items.select("page_id", F.posexplode("a").alias("item_no", "line"))


@register("m5_blocks", rf"""
SELECT page_id, CAST(4 + len(regexp_extract_all({_ART}, '<p\b')) AS BIGINT) AS n_blocks FROM pages
""")
def m5_blocks(spark, sf_dir):
    md = _literal(spark, sf_dir)
    return md.select("page_id", F.size(F.split(F.trim("markdown"), "\n\n")).cast("long").alias("n_blocks"))


@register("m14_literal_markdown")
def m14_literal_markdown(spark, sf_dir):
    md = _literal(spark, sf_dir)
    return md.select("page_id", "markdown", tx.char_count("markdown").alias("chars"), tx.token_count("markdown").alias("tokens"))


@register("m14_preset_markdown")
def m14_preset_markdown(spark, sf_dir):
    run, nodes, _ = _run(spark, sf_dir)
    res, doc = P.apply_presets(run, nodes)
    md = render(doc, keys=("page_id", "preset_id"))
    return res.where("status = 'ok'").select("page_id", "preset_id").join(md, ["page_id", "preset_id"], "left")
