"""Gibberish predicate and score of identifiers."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions.identifiers import gibberish_score, is_gibberish

# Identifiers of our own: generated by hand in the styles of build tools, ids and writers.
CASES = [
    ("q8Zt5RwYx2KvNpLm7DfB", True), ("Xw9Kq2ZrTv7LmPn4Bs8D", True), ("h7_Kx3pQ9mZ1rT5vW8yB", True),
    ("0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9", True), ("9f8e7d6c_5b4a_3928_1706_f5e4d3c2b1a0", True), ("story-48213", True),
    ("footer", False), ("lead-text", False), ("mainMenu", False), ("side-bar-2", False), ("h2", False), ("card-title-text", False),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(CASES, "input string, expected boolean")
    rows = df.select("input", "expected", is_gibberish("input").alias("got"), gibberish_score("input").alias("score")).collect()
    return {r["input"]: r for r in rows}


@pytest.mark.parametrize("value,expected", CASES)
def test_is_gibberish(scored, value, expected):
    assert scored[value]["got"] is expected, scored[value]["score"]


def test_score_edges(spark):
    df = spark.createDataFrame([("",), ("a",), ("ab",), ("a\U0001F600b",)], "v string")
    got = {r["v"]: r["s"] for r in df.select("v", gibberish_score("v").alias("s")).collect()}
    assert got[""] == 0.0 and got["a"] == 0.0
    assert abs(got["ab"] - 0.1) < 1e-12
    # code points iterate (a, emoji, b): 1.0 + 1.0; divisor is UTF-16 length - 1 = 3
    assert abs(got["a\U0001F600b"] - 2.0 / 3) < 1e-12
