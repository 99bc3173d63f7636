from __future__ import annotations

import pytest

from pagemill.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark(master="local[4]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


#: Documents with every kind of trouble: null and empty texts, null and repeated
#: ids, copies, near copies, a long text, exotic characters, clashing names.
WORDS = "the river of stones keeps under morning light a quiet bridge where nobody counts time and birds return late".split()


def prose(n: int, seed: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


DOCS = [
    (1, prose(80, 1), "en", "a", 1), (2, prose(80, 1), "en", "a", 2), (3, prose(80, 1) + "  \n", "en", "b", 3),
    (4, None, None, None, None), (5, "", "fr", "b", 0), (6, " \t\n ", "fr", "b", 4), (7, "Word", None, "c", 5),
    (None, prose(30, 2), "en", "c", 6), (8, prose(30, 2), "de", "c", 7), (8, prose(30, 2), "de", "c", 7),
    (9, "日本語 テキスト é ß \x1c end", "fr", "d", 8), (10, prose(3000, 3), "en", "d", 9),
    (11, prose(60, 4) + " " + prose(60, 5), "en", "e", 10), (12, prose(40, 6) + " " + prose(60, 5), "en", "e", 11),
    (13, "x" * 900, "de", "e", 12), (14, "ab" * 700 + "<|endoftext|>tail", "de", "e", 13),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Writes rows as a Parquet table, so that operators number the rows of a file scan."""

    def make(rows=DOCS, schema=SCHEMA, files=3, extra=None):
        df = spark.createDataFrame(rows, schema)
        for name, value in (extra or {}).items():
            df = df.selectExpr("*", f"{value} AS `{name}`")
        path = str(tmp_path_factory.mktemp("table") / "t")
        df.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return make
