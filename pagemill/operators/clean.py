"""HTML cleanup (C1-C10) as transformations of the node table.

Step order is semantic and follows the reference: entity pre-decode and
parse (N1, N3), scope to body (C1), drop non-renderable subtrees (C2), drop
comments (C3), truncate text (C4), attribute allow-list (C5), drop
gibberish ids/classes/data values (C6), prune empty elements to a fixpoint
(C7, closed form), rewrite same-host URLs (C8), truncate attributes (C9).

The result keeps only nodes inside ``<body>``; ``cleaned_html`` wraps them
back as ``<html><body>...</body></html>`` (empty when nothing survives),
which is what re-parsing the body and pruning the empty head yields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.identifiers import is_gibberish
from pagemill.functions.text import canonical_host, let, truncate_attr, truncate_text, utf16_len
from pagemill.operators.nodes import NODE_COLUMNS, ATTR_TYPE, node_table, serialize
from pagemill.session import bucketed
from pagemill.operators.structure import inside_marked, subtree_has, tighten_ends

# Fixed values that must equal the reference's.
NON_RENDERABLE_TAGS = ["script", "style", "iframe", "embed", "object", "meta", "svg", "path", "canvas",
                       "video", "audio", "picture", "source", "track"]
NON_RENDERABLE_WITH_ATTR = {"link": "rel"}
ALLOWED_ATTRIBUTES = ["id", "class", "href", "lang", "title", "alt", "value", "name", "placeholder", "checked",
                      "selected", "disabled", "readonly", "action", "method", "src"]
URL_ATTRIBUTES = ["href", "src", "action"]
ABSOLUTE_URL_RX = r"^(?i)(https?:)?//"


def _is_el() -> Column:
    return F.col("kind") == "element"


def scope_to_body(nodes: DataFrame) -> DataFrame:
    """Keep nodes strictly inside the first ``<body>``; re-root them."""
    body = (nodes.where(_is_el() & (F.col("tag") == "body"))
            .groupBy("page_id").agg(F.min(F.struct("pre", "pre_end", "depth")).alias("b")))
    j = nodes.join(body, "page_id")
    inside = (F.col("pre") > F.col("b.pre")) & (F.col("pre") <= F.col("b.pre_end"))
    return j.where(inside).select(
        "page_id", "pre", "pre_end",
        F.when(F.col("parent") == F.col("b.pre"), F.lit(-1)).otherwise(F.col("parent")).alias("parent"),
        (F.col("depth") - F.col("b.depth") - 1).alias("depth"),
        "sib_no", "kind", "tag", "attrs", "text",
    )


def non_renderable() -> Column:
    tag, attrs = F.col("tag"), F.col("attrs")
    link = F.lit(False)
    for t, a in NON_RENDERABLE_WITH_ATTR.items():
        link = link | ((tag == t) & F.coalesce(F.exists(attrs, lambda x: x["name"] == F.lit(a)), F.lit(False)))
    return _is_el() & (tag.isin(NON_RENDERABLE_TAGS) | link)


def drop_non_renderable(nodes: DataFrame) -> DataFrame:
    """Subtree removal of the non-renderable selectors."""
    return nodes.withColumn("_drop", inside_marked(non_renderable())).where(~F.col("_drop")).drop("_drop")


def drop_comments(nodes: DataFrame) -> DataFrame:
    """C3."""
    return nodes.where(F.col("kind") != "comment")


def truncate_text_nodes(nodes: DataFrame) -> DataFrame:
    """C4: text longer than 120 UTF-16 units -> first 120 + suffix."""
    return nodes.withColumn("text", F.when(F.col("kind") == "text", truncate_text(F.col("text"))).otherwise(F.col("text")))


def allow_attributes(nodes: DataFrame) -> DataFrame:
    """Keep allow-listed attributes and any ``data-*``."""
    keep = F.filter("attrs", lambda a: a["name"].isin(ALLOWED_ATTRIBUTES) | a["name"].startswith("data-"))
    return nodes.withColumn("attrs", F.when(_is_el(), keep).otherwise(F.col("attrs")))


def _class_value(v: Column) -> Column:
    tokens = F.filter(F.split(v, r"(?U)\s+"), lambda t: F.length(t) > 0)
    kept = F.filter(tokens, lambda t: ~is_gibberish(t))
    return (F.when(F.size(kept) == 0, F.lit(None).cast("string"))
            .when(F.size(kept) != F.size(tokens), F.array_join(kept, " "))
            .otherwise(v))


def drop_gibberish(nodes: DataFrame) -> DataFrame:
    """Gibberish id -> drop; class -> drop gibberish tokens (drop the
    attribute when none is left, re-join with one space when some went,
    keep the original string otherwise); data-* -> whole value scored."""
    def fix(a):
        name, v = a["name"], a["value"]
        nv = (F.when((name == "id") & is_gibberish(v), F.lit(None).cast("string"))
              .when(name == "class", _class_value(v))
              .when(name.startswith("data-") & is_gibberish(v), F.lit(None).cast("string"))
              .otherwise(v))
        return F.struct(name.alias("name"), nv.alias("value"))

    fixed = F.filter(F.transform("attrs", fix), lambda a: a["value"].isNotNull())
    needs = F.exists("attrs", lambda a: a["name"].isin("id", "class") | a["name"].startswith("data-"))
    return nodes.withColumn("attrs", F.when(_is_el() & F.coalesce(needs, F.lit(False)), fixed).otherwise(F.col("attrs")))


def mark_survivors(nodes: DataFrame, out: str = "survives") -> DataFrame:
    """C7 in closed form: an element survives iff its subtree (self included)
    holds a text node or an element with at least one attribute."""
    keeper = (F.col("kind") == "text") | (_is_el() & (F.coalesce(F.size("attrs"), F.lit(0)) > 0)) | \
             ~F.col("kind").isin("element", "text")
    return nodes.withColumn(out, ~_is_el() | subtree_has(keeper))


def prune_empty(nodes: DataFrame) -> DataFrame:
    """Drop the elements that the repeated empty-element removal drops."""
    return mark_survivors(nodes, "_keep").where("_keep").drop("_keep")


#: Parts of an absolute or protocol-relative URL: 1 scheme, 2 host and port, 3 path, 4 query, 5 fragment.
_URL_RX = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Characters that a URL holds in percent form, by part; everything beyond ASCII too.
_ILLEGAL = {"path": r"""[\x00-\x20"#<>?`{}\x7f]|[^\x00-\x7f]""", "query": r"""[\x00-\x20"#<>'\x7f]|[^\x00-\x7f]""", "hash": r"""[\x00-\x20"<>`\x7f]|[^\x00-\x7f]"""}


def _percent(value: Column, part: str) -> Column:
    """The illegal characters of a URL part as percent-encoded UTF-8."""
    rx = _ILLEGAL[part]
    each = F.transform(F.split(value, ""), lambda c: F.when(c.rlike(rx), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(value.rlike(rx), F.array_join(each, "")).otherwise(value)


def _without_dots(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved."""
    dot, up = r"^(?:\.|(?i)%2e)$", r"^(?:\.|(?i)%2e){2}$"
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda out, x: F.when(x.rlike(up), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x.rlike(dot), out).otherwise(F.concat(out, F.array(x))))
    last = F.element_at(parts, -1)
    end = F.when(last.rlike(up) | last.rlike(dot), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(F.lit("")), end)
    return F.when(path.rlike(r"(?:^|/)(?:\.|(?i)%2e){1,2}(?:/|$)"), joined).otherwise(path)


def _bare_host(host: Column) -> Column:
    return canonical_host(F.regexp_replace(host, r":\d*$", ""))


def page_host(base_url: Column) -> Column:
    """The canonical host of a page's URL; null where it has none."""
    return F.when(F.regexp_extract(base_url, _URL_RX, 1) != "", F.nullif(_bare_host(F.regexp_extract(base_url, _URL_RX, 2)), F.lit("")))


def same_host_relative(value: Column, base_url: Column, base_host: Column | None = None) -> Column:
    """C8 for one value: absolute (http(s) or protocol-relative) URLs whose
    hostname equals the page's become ``path + ?query + #hash`` (``/`` when
    all are empty), dot segments resolved and illegal characters percent
    encoded; anything else, or anything unparsable, is unchanged. Before the
    query a backslash is a slash; hosts are compared in their canonical form."""
    base_host = page_host(base_url) if base_host is None else base_host
    tidy = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    tidy = let(tidy, lambda v: let(F.regexp_extract(v, r"^[^?#]*", 0), lambda h: F.concat(F.replace(h, F.lit("\\"), F.lit("/")), F.substring(v, F.length(h) + 1, F.length(v)))))

    def relative(t):
        part = lambda k: F.regexp_extract(t, _URL_RX, k)
        path = let(part(3), lambda x: _percent(_without_dots(x), "path"))
        query, ref = let(part(4), lambda x: _percent(x, "query")), let(part(5), lambda x: _percent(x, "hash"))
        rel = F.concat(
            let(path, lambda x: F.when(x == "", F.lit("/")).otherwise(x)),
            let(query, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise(F.lit(""))),
            let(ref, lambda x: F.when(x != "", F.concat(F.lit("#"), x)).otherwise(F.lit(""))))
        return F.when(t.rlike(ABSOLUTE_URL_RX) & (_bare_host(part(2)) == base_host), rel).otherwise(value)

    # no URL without two slashes names a host
    return F.when(base_host.isNotNull() & value.rlike(r"[/\\][\t\n\r]*[/\\]"), let(tidy, relative)).otherwise(value)


def rewrite_urls(nodes: DataFrame, page_urls: DataFrame) -> DataFrame:
    """C8 over href/src/action; a page whose URL does not parse is skipped.

    The (page_id, url) side is small per page; the node side keeps its
    page_id partitioning.
    """
    has_url = _is_el() & F.coalesce(F.exists("attrs", lambda a: a["name"].isin(URL_ATTRIBUTES)), F.lit(False))
    j = nodes.join(page_urls.select("page_id", F.col("url").alias("_base"), page_host(F.col("url")).alias("_host")), "page_id", "left")
    fixed = F.transform("attrs", lambda a: F.struct(
        a["name"].alias("name"),
        F.when(a["name"].isin(URL_ATTRIBUTES) & F.col("_base").isNotNull(),
               same_host_relative(a["value"], F.col("_base"), F.col("_host"))).otherwise(a["value"]).alias("value")))
    return j.withColumn("attrs", F.when(has_url, fixed).otherwise(F.col("attrs"))).drop("_base", "_host")


def truncate_attributes(nodes: DataFrame) -> DataFrame:
    """Every attribute but id and class: > 100 units -> 85 + suffix."""
    t = F.transform("attrs", lambda a: F.struct(
        a["name"].alias("name"),
        F.when(a["name"].isin("id", "class"), a["value"]).otherwise(truncate_attr(a["value"])).alias("value")))
    return nodes.withColumn("attrs", F.when(_is_el(), t).otherwise(F.col("attrs")))


def clean_nodes(pages: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """C1-C9 in order on ``pages(page_id, url, html)``; returns cleaned nodes.

    ``parsed`` may pass an already pre-decoded node table (N1 + N3).
    """
    nodes = parsed if parsed is not None else node_table(pages, predecode=True)
    n = scope_to_body(nodes)
    n = drop_non_renderable(n)
    n = drop_comments(n)
    n = truncate_text_nodes(n)
    n = allow_attributes(n)
    n = drop_gibberish(n)
    n = prune_empty(n)
    n = rewrite_urls(n, pages.select("page_id", "url"))
    n = truncate_attributes(n)
    return bucketed(tighten_ends(n.select("page_id", *NODE_COLUMNS)), "page_id", "pagemill_clean")


def cleaned_html(pages: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """Cleaned html per page plus sizes before and after.

    Pages with no surviving node get ``''`` (html, head and body pruned).
    """
    cn = cleaned if cleaned is not None else clean_nodes(pages)
    inner = serialize(cn, out_col="inner")
    out = pages.select("page_id", "url", "html").join(inner, "page_id", "left")
    html = F.when(F.col("inner").isNull(), F.lit("")).otherwise(F.concat(F.lit("<html><body>"), F.col("inner"), F.lit("</body></html>")))
    return out.select("page_id", "url", html.alias("cleaned_html"),
                      utf16_len("html").alias("raw_chars"), utf16_len(html).alias("clean_chars"))


__all__ = [
    "scope_to_body", "drop_non_renderable", "drop_comments", "truncate_text_nodes", "allow_attributes",
    "drop_gibberish", "prune_empty", "rewrite_urls", "truncate_attributes", "clean_nodes", "cleaned_html",
    "same_host_relative", "ATTR_TYPE",
]
