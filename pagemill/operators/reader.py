"""Reader mode (R1-R5), re-aimed as text-density scoring on the node table.

Per-element text and link-text sizes come from prefix sums of text length
in document order: the subtree of ``e`` is the pre range
``[e.pre, e.pre_end]``, so its text is ``cum[e.pre_end] - cum_before[e.pre]``
(one running window and one equi-join on ``(page_id, pre)``).

* R2 "is it readable": for ``p``, ``pre`` and ``article`` elements whose
  trimmed text has at least 140 characters add ``sqrt(len - 140)``; the page
  is readable when the sum exceeds 20 (the published readerability check).
  ``classified_blocks`` tells for every stretch of text between block tags whether
  it is content, by the decision rule on words and link density of a block and
  its two neighbours that Kohlschuetter et al. published (WSDM 2010).
* R3 content blocks: composite text density (Sun et al., SIGIR 2011) over the
  paragraphs' text outside links. An element's density is its text by block
  tag, weighted down by the links in it; the sum of its children's densities
  tells where text stands side by side. The least density on the way from the
  element with the greatest sum up to ``body`` is the page's threshold, and of
  every element that reaches it the densest part is content: an article in
  several boxes comes out whole, a list of links between them does not. Not
  score-identical to the library the reference calls.
  ``choose_container`` is the single best container, by
  ``p_chars * p_chars / text_chars``.
* R4 metadata from JSON-LD, meta elements, item properties and titles, ranked;
  R5 status envelope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import utf16_len
from pagemill.operators.markdown import render
from pagemill.operators.nodes import NODE_COLUMNS, attr, node_table
from pagemill.operators.structure import inside_marked, open_counts, subtree_sums
from pagemill.session import bucketed, cut

MIN_CONTENT_LENGTH = 140
MIN_SCORE = 20.0
#: Content blocks with less paragraph text than this are left out.
MIN_BLOCK_CHARS = 25
READABLE_TAGS = ["p", "pre", "article"]
CONTAINER_TAGS = ["article", "main", "section", "div", "body", "td", "blockquote"]
SKIP_TAGS = ["script", "style", "noscript", "template", "head"]


def element_text(nodes: DataFrame, own: str | None = None) -> DataFrame:
    """Element rows with ``text_chars``, ``link_chars`` and ``p_chars`` of the
    subtree; with ``own``, a whole number that every node has, also ``own_chars``:
    its sum over the texts that ``p_chars`` counts."""
    el_ = F.col("kind") == "element"
    n = open_counts(nodes, {"_c_skip": (el_ & F.col("tag").isin(SKIP_TAGS), False),
                            "_c_a": (el_ & (F.col("tag") == "a"), False),
                            "_c_p": (el_ & (F.col("tag") == "p"), False)})
    said = (F.col("kind") == "text") & (F.col("_c_skip") == 0)
    sums = {"text_chars": F.when(said, utf16_len("text")),
            "link_chars": F.when(said & (F.col("_c_a") > 0), utf16_len("text")),
            "p_chars": F.when(said & (F.col("_c_p") > 0), utf16_len("text"))}
    if own is not None:
        sums["own_chars"] = F.when(said & (F.col("_c_p") > 0), F.col(own))
    e = nodes.where(el_).select("page_id", "pre", "pre_end", "depth", "tag", "attrs")
    return e.join(subtree_sums(n, sums), ["page_id", "pre"])


def trimmed_lengths(nodes: DataFrame, tags) -> DataFrame:
    """Trimmed text length of the subtree of each element with a tag in ``tags``.

    With all text of the page laid end to end, a subtree's trimmed text runs
    from the first non-blank character at or after its start to the last one
    at or before its end: two running windows over one event table, whatever
    the nesting.
    """
    blank = r"[\s\u00a0\ufeff]"
    is_text = F.col("kind") == "text"
    wanted = (F.col("kind") == "element") & F.col("tag").isin(tags)
    n = nodes.where(is_text | wanted).select(
        "page_id", "pre", "pre_end", "tag", is_text.alias("_is_text"), F.when(is_text, utf16_len("text")).otherwise(F.lit(0)).alias("_t"),
        utf16_len(F.regexp_replace("text", f"^{blank}+", "")).alias("_no_lead"), utf16_len(F.regexp_replace("text", f"{blank}+$", "")).alias("_no_trail"))
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_at", F.coalesce(F.sum("_t").over(order), F.lit(0)))
    solid = F.col("_is_text") & (F.col("_no_lead") > 0)
    n = n.withColumn("_first", F.when(solid, F.col("_at") + F.col("_t") - F.col("_no_lead"))).withColumn("_last", F.when(solid, F.col("_at") + F.col("_no_trail")))
    none = F.lit(None).cast("long")

    def event(pos, side, first, last):
        return F.struct(pos.cast("double").alias("pos"), F.lit(side).alias("side"), first.cast("long").alias("first"), last.cast("long").alias("last"))

    own = event(F.col("pre"), 0, F.col("_first"), F.col("_last"))
    edges = F.array(event(F.col("pre") - F.lit(0.5), 1, none, none), event(F.col("pre_end") + F.lit(0.5), 2, none, none))
    e = n.withColumn("e", F.explode(F.when(F.col("_is_text"), F.array(own)).otherwise(edges)))
    forth = Window.partitionBy("page_id").orderBy("e.pos").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("page_id").orderBy(F.col("e.pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_l", F.max("e.last").over(forth)).withColumn("_f", F.min("e.first").over(back))
    g = e.where("e.side > 0").groupBy("page_id", "pre", "tag").agg(
        F.max(F.when(F.col("e.side") == 2, F.col("_l"))).alias("_l"), F.max(F.when(F.col("e.side") == 1, F.col("_f"))).alias("_f"))
    return g.select("page_id", "pre", "tag", F.greatest(F.coalesce(F.col("_l") - F.col("_f"), F.lit(0)), F.lit(0)).cast("int").alias("len"))


def readable_score(nodes: DataFrame) -> DataFrame:
    """R2: (page_id, score, readable)."""
    lens = trimmed_lengths(nodes, READABLE_TAGS)
    s = lens.where(F.col("len") >= MIN_CONTENT_LENGTH).groupBy("page_id").agg(
        F.sum(F.sqrt(F.col("len") - MIN_CONTENT_LENGTH)).alias("score"))
    pages = nodes.select("page_id").distinct()
    out = pages.join(s, "page_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("readable", F.col("score") > MIN_SCORE)


def choose_container(el: DataFrame) -> DataFrame:
    """(page_id, pre, pre_end, tag) of the best container per page."""
    c = el.where(F.col("tag").isin(CONTAINER_TAGS) & (F.col("p_chars") > 0))
    score = F.col("p_chars") * F.col("p_chars") / F.col("text_chars")
    w = Window.partitionBy("page_id").orderBy(score.desc(), F.col("pre").asc())
    return (c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("page_id", "pre", "pre_end", "tag", "text_chars", "link_chars", "p_chars"))


#: Tags that end a stretch of text.
BREAK_TAGS = ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
              "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]


def text_blocks(nodes: DataFrame) -> DataFrame:
    """R2: (page_id, n, pre, words, link_words): the stretches of text between block
    tags that hold a word, numbered from 1 in document order."""
    is_el, is_text = F.col("kind") == "element", F.col("kind") == "text"
    n = open_counts(nodes, {"_skip": (is_el & F.col("tag").isin(SKIP_TAGS), False), "_a": (is_el & (F.col("tag") == "a"), False)})
    edge = lambda pos: F.struct(pos.cast("double").alias("_pos"), F.lit(1).alias("_edge"))
    own = F.struct(F.col("pre").cast("double").alias("_pos"), F.lit(0).alias("_edge"))
    breaks = is_el & F.col("tag").isin(BREAK_TAGS)
    br = is_el & (F.col("tag") == "br")  # a blank within a block
    n = n.where((F.col("_skip") == 0) & (is_text | breaks | br)).withColumn("text", F.when(br, F.lit("\n")).otherwise(F.col("text")))
    e = n.select("page_id", "pre", "text", "_a", F.explode(F.when(breaks, F.array(edge(F.col("pre")), edge(F.col("pre_end") + F.lit(0.5)))).otherwise(F.array(own))).alias("_e"))
    order = Window.partitionBy("page_id").orderBy("_e._pos").rangeBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_no", F.sum("_e._edge").over(order)).where("_e._edge = 0")
    # one block's text nodes may meet within a word
    words = F.size(F.filter(F.split(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), ""), r"[\s\u00a0]+"), lambda w: w != ""))
    of_links = F.sum(F.when(F.col("_a") > 0, F.size(F.filter(F.split("text", r"[\s\u00a0]+"), lambda w: w != ""))).otherwise(0))
    b = e.groupBy("page_id", "_no").agg(F.min("pre").alias("pre"), words.cast("long").alias("words"), of_links.alias("link_words")).where("words > 0")
    return b.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))).select("page_id", "n", "pre", "words", F.least("link_words", "words").alias("link_words"))


def classified_blocks(nodes: DataFrame) -> DataFrame:
    """R2: ``text_blocks`` with ``link_density`` and ``content``. Before the first and
    behind the last block there is one without words."""
    order = Window.partitionBy("page_id").orderBy("n")
    b = text_blocks(nodes).withColumn("link_density", F.col("link_words") / F.col("words"))
    before, behind = F.lag("words", 1, 0).over(order), F.lead("words", 1, 0).over(order)
    b = b.withColumns({"_prev": before, "_next": behind, "_plinks": F.lag("link_density", 1, 0.0).over(order)})
    # fixed values of the published rule
    few = F.when(F.col("_next") > 15, F.lit(True)).otherwise(F.col("_prev") > 4)
    after_text = F.when(F.col("words") > 16, F.lit(True)).otherwise(few)
    after_links = (F.col("words") > 40) | (F.col("_next") > 17)
    rule = F.when(F.col("link_density") > 0.333333, F.lit(False)).when(F.col("_plinks") <= 0.555556, after_text).otherwise(after_links)
    return b.withColumn("content", rule).drop("_prev", "_next", "_plinks")


#: Tags that text is counted by.
DENSITY_TAGS = [*CONTAINER_TAGS, "p", "pre", "ul", "ol", "dl", "li", "dt", "dd", "table", "tr", "nav", "header", "footer", "aside", "form", "figure", "h1", "h2", "h3", "h4", "h5", "h6"]


def densities(nodes: DataFrame) -> DataFrame:
    """Of every element in ``body`` the sums over its subtree, ``density`` and
    ``density_sum`` (of its children's densities).

    With C the characters of paragraphs outside links, T the block tags, L the
    characters and A the tags of links (each 1 at least where it divides), and
    r the page's share of link text, the density is C / T times the logarithm of
    C / L * T / A to the base ln(C / (C - L) * L + r * C + e).
    """
    is_el = F.col("kind") == "element"
    n = open_counts(nodes, {"_skip": (is_el & F.col("tag").isin(SKIP_TAGS), False), "_a": (is_el & (F.col("tag") == "a"), False),
                            "_p": (is_el & F.col("tag").isin("p", "pre"), False), "_b": (is_el & (F.col("tag") == "body"), False)})
    n = n.where((F.col("_skip") == 0) & (F.col("_b") > 0))
    size, in_a = F.when(F.col("kind") == "text", utf16_len("text")), F.col("_a") > 0
    sums = subtree_sums(n, {
        "text_chars": size, "link_chars": F.when(in_a, size), "p_chars": F.when(F.col("_p") > 0, size), "para": F.when((F.col("_p") > 0) & ~in_a, size),
        "blocks": F.when(is_el & F.col("tag").isin(DENSITY_TAGS), 1), "links": F.when(is_el & (F.col("tag") == "a"), 1), "elements": F.when(is_el, 1)})
    el = n.where(is_el).select("page_id", "pre", "pre_end", "parent", "tag").join(sums, ["page_id", "pre"])
    of_body = F.when(F.col("tag") == "body", F.col("link_chars") / F.greatest("text_chars", F.lit(1)))
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    c, t, li, a = one("para"), one("blocks"), one("link_chars"), one("links")
    ratio = F.max(of_body).over(Window.partitionBy("page_id"))
    base = F.log(c / F.greatest(c - li, F.lit(1.0)) * li + ratio * c + F.lit(2.718281828459045))
    weight = F.log(F.greatest(c / li * t / a, F.lit(1.0))) / F.log(base)
    el = el.withColumn("density", F.when(F.col("para") > 0, c / t * weight).otherwise(F.lit(0.0)))
    el = bucketed(el, "page_id", "pagemill_density")  # read for the elements and for their parents
    total = el.groupBy("page_id", F.col("parent").alias("pre")).agg(F.sum("density").alias("density_sum"))
    return el.join(total, ["page_id", "pre"], "left").withColumn("density_sum", F.coalesce("density_sum", F.lit(0.0)))


def content_blocks(el: DataFrame) -> DataFrame:
    """The maximal content blocks of each page, from ``densities``.

    The element with the greatest sum in a subtree is a maximum over a stretch of
    the elements in document order. Maxima of 1, 2, 4, ... neighbours, each from
    two of the last, give any stretch by two that overlap: as many window
    functions as an element count has binary digits, no pairs of elements.
    """
    order = Window.partitionBy("page_id").orderBy("pre")
    e = el.withColumn("idx", F.row_number().over(order) - 1)
    top = F.min_by(F.struct("pre", "pre_end"), F.struct(-F.col("density_sum"), "pre"))
    best = e.groupBy("page_id").agg(top.alias("_top"), F.max("density_sum").alias("_sum")).where("_sum > 0")
    e = e.join(best.select("page_id", F.col("_top.pre").alias("_m")), "page_id")
    on_path = (F.col("pre") <= F.col("_m")) & (F.col("pre_end") >= F.col("_m"))
    e = e.withColumn("_least", F.min(F.when(on_path, F.col("density"))).over(Window.partitionBy("page_id")))
    e = cut(e.withColumn("_m0", F.struct(F.col("density_sum").alias("s"), (-F.col("idx")).alias("i"))))
    most = e.agg(F.max("elements")).first()[0] or 1  # one number
    levels = max(1, int(most).bit_length())
    for k in range(1, levels):
        other = F.lead(f"_m{k - 1}", 1 << (k - 1)).over(order)
        e = e.withColumn(f"_m{k}", F.when(other.isNotNull() & (other > F.col(f"_m{k - 1}")), other).otherwise(F.col(f"_m{k - 1}")))
    e = e.withColumn("_all", F.array(*[f"_m{k}" for k in range(levels)])).drop(*[f"_m{k}" for k in range(levels)])
    level = F.floor(F.log2(F.col("elements").cast("double"))).cast("int")
    dense = e.where((F.col("density") >= F.col("_least")) & (F.col("density") > 0)).select(
        "page_id", F.get("_all", level).alias("_one"), level.alias("_k"), (F.col("idx") + F.col("elements") - F.pow(F.lit(2.0), level)).cast("int").alias("idx"))
    dense = dense.join(e.select("page_id", "idx", "_all"), ["page_id", "idx"]).withColumn("_two", F.get("_all", F.col("_k")))
    marked = dense.select("page_id", (-F.greatest("_one", "_two")["i"]).alias("idx")).distinct()
    kept = e.join(marked, ["page_id", "idx"]).drop("_all")
    return kept.withColumn("_in", inside_marked(F.lit(True), strict=True)).where(~F.col("_in") & (F.col("para") >= MIN_BLOCK_CHARS)).select(
        "page_id", "pre", "pre_end", "tag", "text_chars", "link_chars", "p_chars", "density")


#: Names of the vocabularies a field is read from, best first (fixed values).
META_NAMES = {
    "title": ["dc:title", "dcterm:title", "og:title", "weibo:article:title", "weibo:webpage:title", "title", "twitter:title"],
    "byline": ["dc:creator", "dcterm:creator", "author", "parsely-author", "article:author"],
    "excerpt": ["dc:description", "dcterm:description", "og:description", "weibo:article:description", "weibo:webpage:description", "description", "twitter:description"],
    "siteName": ["og:site_name"],
    "publishedTime": ["article:published_time", "parsely-pub-date", "date"],
}
ITEM_PROPS = {"title": "headline", "byline": "author", "excerpt": "description", "publishedTime": "datepublished"}
#: Article and the types below it at schema.org (fixed values).
ARTICLE_TYPES = ["Article", "AdvertiserContentArticle", "NewsArticle", "AnalysisNewsArticle", "AskPublicNewsArticle", "BackgroundNewsArticle", "OpinionNewsArticle",
                 "ReportageNewsArticle", "ReviewNewsArticle", "Report", "SatiricalArticle", "ScholarlyArticle", "MedicalScholarlyArticle", "SocialMediaPosting",
                 "BlogPosting", "LiveBlogPosting", "DiscussionForumPosting", "TechArticle", "APIReference"]
#: Ranks of a field's sources; in between are the names above.
RANK_STRUCTURED, RANK_ITEM, RANK_DOCUMENT, RANK_HEADING = 0, 100, 200, 300
#: Words that a part of a document's title needs to stand alone.
TITLE_WORDS = 3


def _at(item, path: str):
    """A JSON string, trimmed; null where there is another kind of value."""
    v = F.try_variant_get(item, path, "variant")
    text = F.trim(F.regexp_replace(F.try_variant_get(v, "$", "string"), r"[\s\u00a0]+", " "))
    return F.when((F.schema_of_variant(v) == "STRING") & (text != ""), text)


def _listed(item, path: str):
    """A JSON list's values, or the value alone."""
    v = F.try_variant_get(item, path, "variant")
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))


def _names(item, path: str):
    """The names of one or several people, given as strings or as objects."""
    each = F.transform(_listed(item, path), lambda x: F.coalesce(_at(x, "$"), _at(x, "$.name")))
    return F.nullif(F.array_join(each, ", "), F.lit(""))


def structured_data(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, n, type, title, byline, siteName, publishedTime, excerpt):
    the articles that JSON-LD scripts describe; ``n`` is the place in the script.
    What is no JSON, of another vocabulary or of another type gives no row."""
    script = (F.col("kind") == "element") & (F.col("tag") == "script") & (F.lower(F.trim(F.regexp_replace(attr("type"), ";.*", ""))) == "application/ld+json")
    scripts = nodes.where(script).select("page_id", "pre")
    texts = nodes.where("kind = 'text'").select("page_id", F.col("parent").alias("pre"), F.col("pre").alias("_at"), "text").join(scripts, ["page_id", "pre"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), "")
    bare = F.regexp_replace(whole, r"^\s*<!\[CDATA\[|\]\]>\s*$", "")
    v = texts.groupBy("page_id", "pre").agg(F.try_parse_json(bare).alias("_v")).where("_v IS NOT NULL")
    tops = v.select("page_id", "pre", F.posexplode(_listed(F.col("_v"), "$")).alias("_i", "_top"))
    graph = F.coalesce(F.try_variant_get("_top", "$['@graph']", "array<variant>"), F.array().cast("array<variant>"))
    of_schema = F.to_json(F.try_variant_get("_top", "$['@context']", "variant")).rlike(r"https?:(\\?/){2}schema\.org")
    items = tops.where(of_schema).select("page_id", "pre", "_i", F.posexplode(F.concat(F.array("_top"), graph)).alias("_j", "_x"))
    x = F.col("_x")
    kinds = F.transform(_listed(x, "$['@type']"), lambda t: F.regexp_replace(_at(t, "$"), r"^https?://schema\.org/", ""))
    found = F.get(F.filter(kinds, lambda t: t.isin(ARTICLE_TYPES)), 0)
    rows = items.withColumn("type", found).where("type IS NOT NULL").select(
        "page_id", "pre", F.row_number().over(Window.partitionBy("page_id", "pre").orderBy("_i", "_j")).alias("n"), "type",
        F.coalesce(_at(x, "$.headline"), _at(x, "$.name")).alias("title"), _names(x, "$.author").alias("byline"), _at(x, "$.publisher.name").alias("siteName"),
        _at(x, "$.datePublished").alias("publishedTime"), _at(x, "$.description").alias("excerpt"))
    return rows


def title_part(title):
    """A document's title without the site's name: of two parts the first, else the
    second, that has ``TITLE_WORDS`` words; else, and with more separators, all."""
    sep = r"\s[|\-\u2013\u2014\\/>\u00bb]\s"
    parts = F.transform(F.split(title, sep), F.trim)
    whole = F.filter(parts, lambda part: F.size(F.split(part, " ")) >= TITLE_WORDS)
    return F.when(F.size(parts) == 2, F.coalesce(F.get(whole, 0), title)).otherwise(title)


def metadata(nodes: DataFrame) -> DataFrame:
    """(page_id, lang, dir, title, byline, siteName, publishedTime, excerpt).

    Every place that may tell a field is a row with its rank: JSON-LD, then meta
    elements by the order of ``META_NAMES``, then item properties, then the
    document's title without the site's name and the first ``h1``. One aggregate
    takes the best, of equals the first in the document; blank values do not count.
    """
    is_el = F.col("kind") == "element"
    el = nodes.where(is_el)
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")), F.lit(""))

    def place(field, rank, value):
        return F.struct(F.lit(field).alias("field"), rank.cast("int").alias("rank"), clean(value).alias("value"))

    def told(rows, places):
        return rows.select("page_id", "pre", F.explode(F.array(*places)).alias("_p")).select("page_id", "pre", "_p.*").where("rank IS NOT NULL AND value IS NOT NULL")

    words = F.split(F.translate(F.lower(F.trim(F.concat_ws(" ", attr("property"), attr("name")))), ".", ":"), r"\s+")

    def rank_of(names):
        places = F.transform(words, lambda w: F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), w), F.lit(0)))
        return F.array_min(places)

    of_meta = told(el.where("tag = 'meta'"), [place(f, rank_of(names), attr("content")) for f, names in META_NAMES.items()])
    of_data = told(structured_data(nodes), [place(f, F.lit(RANK_STRUCTURED), F.col(f)) for f in META_NAMES])
    # elements that tell by their text, the outermost of them, so that no text is read twice
    props = F.split(F.lower(F.trim(F.coalesce(attr("itemprop"), F.lit("")))), r"\s+")
    item = {f: F.array_contains(props, name) for f, name in ITEM_PROPS.items()}
    item["byline"] = item["byline"] | F.coalesce(F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "author") & (F.col("tag") == "a"), F.lit(False))
    tells = F.col("tag").isin("title", "h1")
    for is_item in item.values():
        tells = tells | is_item
    tells = is_el & (F.col("tag") != "meta") & tells
    marked = nodes.select("page_id", "pre", "pre_end", "kind", "text", "tag", tells.alias("_tells"), inside_marked(tells, strict=True).alias("_in"), F.coalesce(attr("content"), attr("datetime")).alias("_given"),
                          *[F.when(tells, x).otherwise(False).alias(f"_is_{f}") for f, x in item.items()])
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    held = marked.withColumn("_mark", F.last(F.when(F.col("_tells") & ~F.col("_in"), F.struct("pre", "pre_end")), ignorenulls=True).over(order))
    owned = held.where("_mark.pre_end >= pre AND (kind = 'text' OR pre = _mark.pre)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pre", "text")))), lambda x: x["text"]), "")
    root = F.col("pre") == F.col("_mark.pre")
    texts = owned.groupBy("page_id", F.col("_mark.pre").alias("_root")).agg(
        whole.alias("_text"), *[F.max(F.when(root, F.col(c))).alias(c) for c in ("tag", "_given", *[f"_is_{f}" for f in item])]).withColumnRenamed("_root", "pre")
    by_item = [place(f, F.when(F.col(f"_is_{f}"), RANK_ITEM), F.coalesce("_given", "_text")) for f in item]
    document = place("title", F.when(F.col("tag") == "title", RANK_DOCUMENT), title_part(clean(F.col("_text"))))
    heading = place("title", F.when(F.col("tag") == "h1", RANK_HEADING), F.col("_text"))
    places = of_meta.unionByName(of_data).unionByName(told(texts, [*by_item, document, heading]))  # some rows a page
    best = lambda f: F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("rank", "pre"))).alias(f)
    fields = places.groupBy("page_id").agg(*[best(f) for f in META_NAMES])

    def of_html(name):
        return F.min_by(attr(name), F.when((F.col("tag") == "html") & attr(name).isNotNull(), F.col("pre"))).alias(name)

    return el.groupBy("page_id").agg(of_html("lang"), of_html("dir")).join(fields, "page_id", "left")


def first_paragraph(nodes: DataFrame, el: DataFrame, best: DataFrame) -> DataFrame:
    """(page_id, first_p): trimmed text of the first non-blank ``p`` of the content."""
    held = el.where((F.col("tag") == "p") & (F.col("text_chars") > 0)).join(best.select("page_id", F.col("pre").alias("r_pre"), F.col("pre_end").alias("r_end")), "page_id")
    p = (held.where((F.col("pre") > F.col("r_pre")) & (F.col("pre") <= F.col("r_end")))
         .groupBy("page_id").agg(F.min(F.struct("pre", "pre_end")).alias("p")))
    texts = nodes.where(F.col("kind") == "text").select("page_id", "pre", "text").join(p, "page_id").where((F.col("pre") > F.col("p.pre")) & (F.col("pre") <= F.col("p.pre_end")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "")
    return texts.groupBy("page_id").agg(F.trim(F.regexp_replace(whole, r"[\s\u00a0]+", " ")).alias("first_p"))


def reader_mode(pages: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(page_id, status, markdown, meta STRUCT<title, length, excerpt,
    byline, siteName, lang, publishedTime, dir>)``."""
    nodes = nodes if nodes is not None else node_table(pages)
    blank = pages.select("page_id", (F.col("html").isNull() | (F.length(F.trim("html")) == 0)).alias("blank"))
    el = cut(densities(nodes))
    best = cut(content_blocks(el))
    readable = readable_score(nodes)
    marks = best.select("page_id", "pre", F.lit(True).alias("_block"))
    sub = (nodes.join(marks, ["page_id", "pre"], "left").withColumn("_in", inside_marked(F.coalesce("_block", F.lit(False))))
           .where("_in").select("page_id", *NODE_COLUMNS))
    md = render(sub, ("page_id",))
    meta = metadata(nodes)
    failed = nodes.where(F.col("kind") == "error").select("page_id", F.lit(True).alias("unparsed")).distinct()
    out = (blank.join(readable, "page_id", "left").join(best.groupBy("page_id").agg(F.sum("text_chars").alias("_content_len")), "page_id", "left")
           .join(md, "page_id", "left").join(meta, "page_id", "left").join(failed, "page_id", "left")
           .join(first_paragraph(nodes, el, best), "page_id", "left"))
    status = (F.when(F.col("blank"), F.lit("not_applicable"))
              .when(F.col("unparsed"), F.lit("failed_to_apply"))
              .when(~F.coalesce(F.col("readable"), F.lit(False)), F.lit("not_applicable"))
              .when(F.col("markdown").isNull(), F.lit("failed_to_apply"))
              .otherwise(F.lit("ok")))
    return out.select(
        "page_id", status.alias("status"),
        F.when(status == "ok", F.col("markdown")).alias("markdown"),
        F.when(status == "ok", F.struct(
            "title", F.coalesce(F.col("_content_len"), F.lit(0)).cast("long").alias("length"),
            F.coalesce("excerpt", F.nullif("first_p", F.lit(""))).alias("excerpt"), "byline",
            "siteName", "lang", "publishedTime", "dir")).alias("meta"),
    )
