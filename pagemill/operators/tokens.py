"""Token-level HTML jobs (N2) and the token-level cleanup used by the
flagship report. Native regular expressions only; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the tokenising pattern (identical in Java regex and RE2).
TOKEN_RX = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]+>|[^<]+"
NON_RENDER_RX = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BODY_RX = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)"


def tokenize(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(page_id, pos, tok, kind)``; lossless, ``pos`` is 0-based."""
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(TOKEN_RX), 0)).alias("pos", "tok"))
    kind = (
        F.when(F.col("tok").startswith("<!--"), "comment")
        .when(F.col("tok").rlike(r"^(?i)<(script|style)\b"), "rawtext")
        .when(F.col("tok").startswith("</"), "end")
        .when(F.col("tok").rlike(r"^<[A-Za-z]"), "start")
        .when(F.col("tok").startswith("<!"), "decl")
        .otherwise("text")
    )
    return t.withColumn("kind", kind)


def token_clean(html: Column) -> Column:
    """C1-C3 at token level: drop comments, script and style blocks, then keep
    the inside of ``<body>`` (the whole document when there is none)."""
    stripped = F.regexp_replace(html, NON_RENDER_RX, "")
    return F.when(stripped.rlike(r"(?i)<body\b"), F.regexp_extract(stripped, BODY_RX, 1)).otherwise(stripped)
