"""Connected components of a table of links, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (columns a, b), root the smallest
    node that can be reached.

    Large-star and small-star rounds (each a minimum by node, which is
    combined before the shuffle, and a join that is split where a node is
    hot) until no link changes. Each round is written to the shared folder.
    No links give no rows; loops, nulls and repeated links are ignored.
    """
    now = materialise(links.select("a", "b").where("a != b").distinct(), "links")
    mark = _mark(now)
    while True:
        large = _star(now.union(now.select("b", "a")), "v > u")
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "true")
        now = materialise(small, "links")
        mark, before = _mark(now), mark
        if mark == before:
            break
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _star(links: DataFrame, keep: str) -> DataFrame:
    """Link every node's neighbours (those that ``keep`` admits) to the least of them and itself."""
    pairs = links.toDF("u", "v")
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    both = pairs.join(least, "u")
    out = both.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep == "true":
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _mark(links: DataFrame):
    """Equal for equal link tables."""
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
