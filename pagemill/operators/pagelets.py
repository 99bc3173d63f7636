"""Pagelets and templates (Bar-Yossef & Rajagopalan, WWW 2002).

A page falls into pagelets by its links: going down from ``body``, an element of
which no child holds ``MIN_LINKS`` links is a pagelet and is not divided
further. As subtrees nest, that is one subtree sum, one aggregate over children
and one running window: a pagelet is an undivided element that lies in no other.

Each pagelet is sketched by its words: of the hashes of all shingles of
``SHINGLE`` words the least under each of ``HASHES`` functions, hashed together.
Pagelets with one sketch on ``TEMPLATE_PAGES`` pages of a host are a template,
whatever their tags and classes are called; two kinds of box with one signature
are told apart by what they say.

All steps but the last aggregate are keyed by page; templates are counted by
(host, sketch) with partial aggregation, so a hot host is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import url_host
from pagemill.operators.nodes import attr, class_tokens
from pagemill.operators.structure import inside_marked, subtree_sums

MIN_LINKS = 3
SHINGLE, HASHES = 4, 4
TEMPLATE_PAGES = 3
_SKIP = ["script", "style", "noscript", "template"]


def _selector() -> F.Column:
    cls = F.array_join(F.array_sort(class_tokens()), ".")
    return F.when(F.length(cls) > 0, F.concat("tag", F.lit("."), cls)).otherwise(F.col("tag"))


def pagelets(nodes: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    """(page_id, pre, pre_end, tag, selector, links) of every page's pagelets."""
    is_el = F.col("kind") == "element"
    link = is_el & (F.col("tag") == "a") & attr("href").isNotNull()
    in_body = inside_marked(is_el & (F.col("tag") == "body"))
    el = nodes.withColumn("_in", in_body).where(is_el & F.col("_in")).join(subtree_sums(nodes, {"links": link.cast("long")}), ["page_id", "pre"])
    most = el.groupBy("page_id", F.col("parent").alias("pre")).agg(F.max("links").alias("_most"))
    el = el.join(most, ["page_id", "pre"], "left").withColumn("_whole", F.coalesce("_most", F.lit(0)) < min_links)
    return (el.withColumn("_inside", inside_marked(F.col("_whole"), strict=True)).where("_whole AND NOT _inside")
            .select("page_id", "pre", "pre_end", "tag", _selector().alias("selector"), "links"))


def pagelet_words(nodes: DataFrame, lets: DataFrame) -> DataFrame:
    """(page_id, let, n, word): the words of each pagelet (``let`` is its pre), numbered from 1."""
    marks = lets.select("page_id", "pre", F.struct(F.col("pre").alias("let"), "pre_end").alias("_let"))
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    n = nodes.select("page_id", "pre", "pre_end", "kind", "tag", "text").withColumn("_skip", inside_marked((F.col("kind") == "element") & F.col("tag").isin(_SKIP)))
    n = n.join(marks, ["page_id", "pre"], "left").withColumn("_last", F.last("_let", ignorenulls=True).over(order))
    texts = n.where((F.col("kind") == "text") & ~F.col("_skip") & (F.col("_last.pre_end") >= F.col("pre"))).select("page_id", F.col("_last.let").alias("let"), "pre", "text")
    words = texts.select("page_id", "let", "pre", F.posexplode(F.filter(F.split("text", r"[\s ]+"), lambda w: w != "")).alias("i", "word"))
    return words.withColumn("n", F.row_number().over(Window.partitionBy("page_id", "let").orderBy("pre", "i"))).select("page_id", "let", "n", "word")


def sketches(words: DataFrame, shingle: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """(page_id, let, words, sketch); fewer words than a shingle are one shingle."""
    order = Window.partitionBy("page_id", "let").orderBy("n")
    parts = ["word", *[f"_w{k}" for k in range(1, shingle)]]
    w = words.withColumns({f"_w{k}": F.lead("word", k).over(order) for k in range(1, shingle)})
    full = F.col(parts[-1]).isNotNull() | (F.col("n") == 1)
    h = F.when(full, F.xxhash64(*parts))
    least = [F.min(F.xxhash64(h, F.lit(k))).alias(f"_m{k}") for k in range(hashes)]
    g = w.where(full).groupBy("page_id", "let").agg(F.count(F.lit(1)).alias("_n"), *least)
    size = words.groupBy("page_id", "let").agg(F.max("n").cast("long").alias("words"))
    return g.join(size, ["page_id", "let"]).select("page_id", "let", "words", F.xxhash64(*[f"_m{k}" for k in range(hashes)]).alias("sketch"))


def sketched_pagelets(nodes: DataFrame, pages: DataFrame, min_links: int = MIN_LINKS) -> DataFrame:
    """The pagelets with their host, number of words and sketch (null without words)."""
    lets = pagelets(nodes, min_links)
    found = sketches(pagelet_words(nodes, lets)).withColumnRenamed("let", "pre")
    hosts = pages.select("page_id", url_host("url").alias("host"))
    return lets.join(found, ["page_id", "pre"], "left").join(hosts, "page_id").withColumn("words", F.coalesce("words", F.lit(0)))


def templates(lets: DataFrame, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(host, sketch, pages, pagelets, selector): sketches that stand on ``least``
    pages of a host, with the least of their pagelets' selectors."""
    of_page = lets.where("sketch IS NOT NULL AND host IS NOT NULL").groupBy("host", "sketch", "page_id").agg(F.count(F.lit(1)).alias("_n"), F.min("selector").alias("_s"))
    out = of_page.groupBy("host", "sketch").agg(F.count(F.lit(1)).alias("pages"), F.sum("_n").alias("pagelets"), F.min("_s").alias("selector"))
    return out.where(F.col("pages") >= least)
