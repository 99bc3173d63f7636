"""Page and preset sources and sinks.

Schemas are declared, never inferred. Validation splits a DataFrame into
valid rows and rejects with a reason instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import is_valid_url, slugify, url_host

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

PRESET_FIELDS = ["preset_match_detectors", "main_content_selectors", "main_content_filters"]
PRESET_SCHEMA = T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in PRESET_FIELDS])
PRESETS_TABLE_SCHEMA = T.StructType([
    T.StructField("preset_id", T.LongType()),
    T.StructField("host", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    *PRESET_SCHEMA.fields,
])


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``pages`` table (parquet, page_id/url/html)."""
    return spark.read.schema(PAGES_SCHEMA).parquet(table_path(sf_dir, "pages"))


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots written as JSON lines ``{url, html}`` (S6 output)."""
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    df = spark.read.schema(schema).json(path)
    # two captures of one address are two pages; the same capture twice is one
    return df.withColumn("page_id", F.xxhash64("url", "html")).dropDuplicates(["page_id", "url"]).select("page_id", "url", "html")


def validate_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Url must parse as a URL and html must be non-empty.

    Returns ``(valid, rejects)``; rejects carry a ``reason``.
    """
    url_ok = F.coalesce(is_valid_url("url"), F.lit(False))
    html_ok = F.coalesce(F.length("html") >= 1, F.lit(False))
    flagged = pages.withColumn(
        "reason",
        F.when(~url_ok, F.lit("invalid_url")).when(~html_ok, F.lit("empty_html")),
    )
    valid = flagged.where(F.col("reason").isNull()).drop("reason")
    rejects = flagged.where(F.col("reason").isNotNull())
    return valid, rejects


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", url_host("url"))


# ---- presets (S2) ---------------------------------------------------------

def parse_presets(raw: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Strict preset parsing: exactly the three keys, detectors and main
    selectors non-empty lists, every selector a non-empty string.

    Returns ``(presets, rejects)``; presets keep every other input column.
    """
    keys = F.json_object_keys(F.col(json_col))
    parsed = raw.withColumn("_p", F.from_json(F.col(json_col), PRESET_SCHEMA))
    expected = F.array(*[F.lit(k) for k in sorted(PRESET_FIELDS)])
    all_str = lambda c: F.coalesce(F.forall(c, lambda s: s.isNotNull() & (F.length(s) > 0)), F.lit(False))
    ok = (
        F.coalesce(F.array_sort(keys) == expected, F.lit(False))
        & (F.size(F.col("_p.preset_match_detectors")) >= 1)
        & (F.size(F.col("_p.main_content_selectors")) >= 1)
        & F.col("_p.main_content_filters").isNotNull()
        & all_str(F.col("_p.preset_match_detectors"))
        & all_str(F.col("_p.main_content_selectors"))
        & F.coalesce(F.forall(F.col("_p.main_content_filters"), lambda s: s.isNotNull() & (F.length(s) > 0)), F.lit(False))
    )
    flagged = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    presets = flagged.where("_ok").select(*[c for c in raw.columns if c != json_col], *[F.col(f"_p.{f}").alias(f) for f in PRESET_FIELDS])
    rejects = flagged.where(~F.col("_ok")).drop("_p", "_ok")
    return presets, rejects


def presets_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Small driver-side preset list -> presets table (tests and examples)."""
    data = [
        (int(r.get("preset_id", i)), r.get("host"), int(r.get("priority", 0)),
         list(r["preset_match_detectors"]), list(r["main_content_selectors"]), list(r.get("main_content_filters", [])))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, PRESETS_TABLE_SCHEMA)


# ---- method inputs and sinks (S3-S6) --------------------------------------

def method_input(pages: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """S3: the pages plus ``ext_markdown`` and ``ext_html`` that another service
    made of their URL; a missing format becomes an ``error`` text instead of a
    failure. Of several rows for a URL the one with markdown, then the least, counts."""
    none = F.lit(None).cast("string")
    if external is None:
        df = pages.withColumns({"ext_markdown": none, "ext_html": none})
    else:
        html = F.col("html") if "html" in external.columns else none
        one = external.select("url", F.struct("markdown", html.alias("html")).alias("e")).groupBy("url").agg(
            F.min_by("e", F.struct(F.col("e.markdown").isNull(), "e")).alias("e"))
        df = pages.join(one, "url", "left").withColumns({"ext_markdown": F.col("e.markdown"), "ext_html": F.col("e.html")}).drop("e")
    err = F.concat_ws(
        "; ",
        F.when(F.col("ext_html").isNull(), F.lit("html missing")),
        F.when(F.col("ext_markdown").isNull(), F.lit("markdown missing")),
    )
    return df.withColumn("error", F.nullif(err, F.lit("")))


def write_markdown(df: DataFrame, path: str, markdown_col: str = "markdown") -> None:
    """Markdown per page keyed by ``slug``, partitioned by host bucket
    (one file per partition, never one file per row)."""
    from pagemill.functions.text import host_bucket

    (df.where(F.col(markdown_col).isNotNull() & (F.length(markdown_col) > 0))
       .select(slugify("url").alias("slug"), "url", F.col(markdown_col).alias("markdown"), host_bucket("url").alias("host_bucket"))
       .write.mode("overwrite").partitionBy("host_bucket").parquet(path))


def write_snapshots(pages: DataFrame, path: str) -> None:
    """``{url, html}`` snapshots as JSON lines; a failed fetch (null html)
    is written as ``''`` and rejected by S1 on reading back."""
    pages.select("url", F.coalesce(F.col("html"), F.lit("")).alias("html")).write.mode("overwrite").json(path)
