"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the DuckDB
oracle SQL for each one that has a SQL equivalent.

Every query reads the driver's tables (mostly ``pages``) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.functions.identifiers import gibberish_score, is_gibberish
from pagemill.operators import tokens as tk
from pagemill.sources.pages import read_pages, table_path, validate_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


# ---------------------------------------------------------------------------
# Flagship: chars and tokens saved per host by scoping to body and dropping
# script, style and comments (N2 + C1-C3 at token level, K1, K2).
# ---------------------------------------------------------------------------

FLAGSHIP_SQL = r"""
WITH p AS (
  SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)) AS host, html,
         regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS s
  FROM pages
), c AS (
  SELECT host, html,
         CASE WHEN regexp_matches(s, '(?i)<body\b') THEN regexp_extract(s, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1) ELSE s END AS clean
  FROM p
)
SELECT host,
       count(*) AS pages,
       sum(CAST(ceil(length(html) / 4.0) AS BIGINT)) AS raw_tokens,
       sum(CASE WHEN length(clean) = 0 THEN 0 ELSE CAST(ceil(length(clean) / 4.0) AS BIGINT) END) AS clean_tokens,
       sum(CAST(ceil(length(html) / 4.0) AS BIGINT))
         - sum(CASE WHEN length(clean) = 0 THEN 0 ELSE CAST(ceil(length(clean) / 4.0) AS BIGINT) END) AS saved_tokens
FROM c GROUP BY host
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_pages(spark, sf_dir)
    per_page = pages.select(
        tx.url_host("url").alias("host"),
        F.coalesce(tx.token_count("html"), F.lit(0)).alias("raw"),
        F.coalesce(tx.token_count(tk.token_clean(F.col("html"))), F.lit(0)).alias("clean"),
    )
    return per_page.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("raw").alias("raw_tokens"),
        F.sum("clean").alias("clean_tokens"),
        (F.sum("raw") - F.sum("clean")).alias("saved_tokens"),
    )


register("flagship_token_savings", FLAGSHIP_SQL)(flagship)


# ---------------------------------------------------------------------------
# S1 validation
# ---------------------------------------------------------------------------

@register("s1_valid_pages", r"""
SELECT page_id,
       (regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AND length(html) >= 1) AS valid
FROM pages
""")
def s1_valid_pages(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    valid, rejects = validate_pages(pages)
    return valid.select("page_id", F.lit(True).alias("valid")).unionByName(
        rejects.select("page_id", F.lit(False).alias("valid")))


# ---------------------------------------------------------------------------
# N2 tokens
# ---------------------------------------------------------------------------

@register("n2_tokens", r"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, tok
FROM (
  SELECT page_id, unnest(t) AS tok, unnest(range(1, len(t) + 1)) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]+>|[^<]+') AS t FROM pages)
)
""")
def n2_tokens(spark, sf_dir):
    return tk.tokenize(read_pages(spark, sf_dir)).select("page_id", "pos", "tok")


# ---------------------------------------------------------------------------
# G1-G3 identifier scores on real-looking identifiers
# ---------------------------------------------------------------------------

def _gibberish_sql(value_expr: str) -> str:
    """DuckDB form of the score: class string, then a sum over pairs."""
    cls = (f"regexp_replace(translate({value_expr}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', "
           f"'UUUUUUUUUUUUUUUUUUUUUUUUUULLLLLLLLLLLLLLLLLLLLLLLLLLDDDDDDDDDDSS'), '[^ULDS]', 'O', 'g')")
    price = ("CASE substr(k, i, 2) WHEN 'UL' THEN 0.2 WHEN 'LU' THEN 0.5 WHEN 'SU' THEN 0.4 WHEN 'SL' THEN 0.3 "
             "WHEN 'SD' THEN 0.9 WHEN 'UD' THEN 1.4 WHEN 'LD' THEN 1.3 WHEN 'DU' THEN 1.4 WHEN 'DL' THEN 1.5 "
             "WHEN 'DS' THEN 1.2 WHEN 'US' THEN 0.2 WHEN 'LS' THEN 0.2 WHEN 'DD' THEN 1.2 WHEN 'SS' THEN 0.3 "
             "WHEN 'UU' THEN 0.1 WHEN 'LL' THEN 0.1 WHEN 'OO' THEN 0.0 ELSE 1.0 END")
    return f"""
SELECT value,
       CASE WHEN length(value) < 2 THEN 0.0
            ELSE round(list_reduce(list_transform(range(1, length(k)), lambda i: CAST({price} AS DOUBLE)), lambda a, b: a + b, 0.0)
                       / greatest(length(value) - 1, 1), 6) END AS score,
       CASE WHEN length(value) < 4 THEN false
            ELSE list_reduce(list_transform(range(1, length(k)), lambda i: CAST({price} AS DOUBLE)), lambda a, b: a + b, 0.0)
                       / greatest(length(value) - 1, 1) >= 0.3 END AS flag
FROM (SELECT value, {cls} AS k FROM ({{src}}))
"""


_G_SOURCES = {
    "customer": "SELECT c_name AS value FROM customer",
    "part": "SELECT p_brand AS value FROM part UNION ALL SELECT p_name AS value FROM part",
}


def _identifier_values(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(table_path(sf_dir, "customer")).select(F.col("c_name").alias("value"))
    p = spark.read.parquet(table_path(sf_dir, "part"))
    return c.unionByName(p.select(F.col("p_brand").alias("value"))).unionByName(p.select(F.col("p_name").alias("value")))


@register("g1_g2_identifier_scores", _gibberish_sql("value").replace(
    "{src}", " UNION ALL ".join(_G_SOURCES.values())))
def g1_g2_identifier_scores(spark, sf_dir):
    v = _identifier_values(spark, sf_dir)
    return v.select("value", F.round(gibberish_score("value"), 6).alias("score"), is_gibberish("value").alias("flag"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)


def _load_all():
    """Import the modules that register further queries."""
    from pagemill.plans import queries_compare, queries_nodes, queries_presets, queries_reader  # noqa: F401
