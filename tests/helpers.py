from pyspark.sql import functions as F

URL = "https://example.com/some/page"


def pages_df(spark, htmls, url=URL):
    rows = [(i, url if isinstance(url, str) else url[i], h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def clean_one(spark, html, url=URL):
    from pagemill.operators.clean import cleaned_html

    return cleaned_html(pages_df(spark, [html], url)).collect()[0]["cleaned_html"]


def attrs_of(nodes_df, tag):
    return [{a["name"]: a["value"] for a in r["attrs"]} for r in nodes_df.where(F.col("tag") == tag).orderBy("pre").collect()]
