"""Exact deduplication by a 128-bit content hash, confirmed byte by byte.

Rows are grouped by the hash of their normalised text. In groups of two or
more, every member's bytes are compared with one member's; members that
differ (hash collisions) are regrouped by their own bytes.

Defined results: a null text is empty; empty texts equal one another; repeated
rows are separate documents of which one stays; a null id sorts after all
others; an empty table gives no rows; columns named like ours are left alone,
as all internal names begin with ``_xd_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, with_rid

#: Characters deleted before texts are compared.
WHITE = " \t\n\x0b\x0c\r"


def strip_white(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(text: Column) -> Column:
    """128-bit content hash."""
    return F.unhex(F.md5(text.cast("binary")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=strip_white, hash_fn=content_hash, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``_xd_rid`` (its number), ``_xd_keep_id``,
    ``_xd_size``, ``_xd_kept`` and what ``carry`` computes from it.

    Of equal texts the row with the most code points stays, then the smallest
    id, then the first in input order.
    """
    carry = carry or {}
    rows = with_rid(docs, "_xd_rid")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    keyed = materialise(rows.select(
        "_xd_rid", F.col(id_col).alias("_xd_id"), F.length(raw).alias("_xd_n"), hash_fn(normalise(F.col(text_col))).alias("_xd_h"), *[c.alias(n) for n, c in carry.items()]), "exact-keys")

    # Only members of groups of two or more have their bytes compared. Tables
    # that joins meet are written first, so that the joins can split a hot group.
    several = materialise(keyed.groupBy("_xd_h").agg(F.count(F.lit(1)).alias("_xd_c"), F.min("_xd_rid").alias("_xd_first")).where("_xd_c > 1").drop("_xd_c"), "exact-several")
    members = keyed.select("_xd_rid", "_xd_h").join(several, "_xd_h")
    same = materialise(rows.select("_xd_rid", F.col(text_col).alias("_xd_raw")).join(members, "_xd_rid")
                       .select("_xd_rid", "_xd_h", "_xd_first", normalise(F.col("_xd_raw")).alias("_xd_text")), "exact-groups")
    lead = same.where("_xd_rid = _xd_first").select("_xd_h", F.col("_xd_text").alias("_xd_lead"))
    differ = materialise(same.join(lead, "_xd_h").where("_xd_text != _xd_lead").select("_xd_rid", F.col("_xd_text").alias("_xd_own")), "exact-collisions")
    if differ.isEmpty():
        keyed = keyed.withColumn("_xd_own", F.lit(""))
    else:  # bytes of members that differ from their group's first become part of the key
        keyed = keyed.join(differ, "_xd_rid", "left").withColumn("_xd_own", F.coalesce("_xd_own", F.lit("")))

    best = F.min_by(F.struct("_xd_id", "_xd_rid"), F.struct(-F.col("_xd_n"), F.col("_xd_id").isNull(), "_xd_id", "_xd_rid"))
    kept = materialise(keyed.groupBy("_xd_h", "_xd_own").agg(F.count(F.lit(1)).alias("_xd_size"), best.alias("_xd_best")), "exact-kept")
    return keyed.join(kept, ["_xd_h", "_xd_own"]).select(
        "_xd_rid", *carry, F.col("_xd_best._xd_id").alias("_xd_keep_id"), "_xd_size", (F.col("_xd_best._xd_rid") == F.col("_xd_rid")).alias("_xd_kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=strip_white, hash_fn=content_hash) -> DataFrame:
    """All rows and columns of ``docs`` plus ``_xd_keep_id``, ``_xd_size``, ``_xd_kept``."""
    found = groups(docs, id_col, text_col, normalise, hash_fn)
    return with_rid(docs, "_xd_rid").join(found, "_xd_rid").drop("_xd_rid")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    sha = F.sha2(strip_white(F.col("text")).cast("binary"), 256)
    out = groups(docs.select("doc_id", "text"), carry={"doc_id": F.col("doc_id"), "text_sha256": sha})
    return out.select("doc_id", F.col("_xd_keep_id").alias("keep_id"), F.col("_xd_size").alias("group_size"), F.col("_xd_kept").alias("kept"), "text_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts."""
    kept = groups(docs).where("_xd_kept").select("_xd_rid")
    return with_rid(docs, "_xd_rid").join(kept, "_xd_rid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, rowid AS r,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST, r)
"""
