"""Phrases against a count of all n-grams."""
from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import collocations

from .conftest import DOCS, SCHEMA

CLASH = {"phrase": "1", "rank": "2", "a": "3", "n": "4", "f": "5", "r": "6", "part": "7", "score": "8"}


def brute(rows, least, first, most=5):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[i:i + size])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in good.items():
        score, k = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        held = any(other == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (other, q), b in good.items())
        if not held:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, total[lang], -score)
            for lang in out for rank, (score, a, p, left, right) in enumerate(sorted(out[lang])[:first], 1)]


def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "é", "日本", "the", "of"]
    out = list(DOCS)
    for i in range(150):
        parts = [rng.choice(["the quick brown fox jumps", "New  York\tCity", "of the", "a a a a", "new york"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \x0b", "!?", "; :", "\x1c", "\xa0 "]) for p in parts)
        out.append((i % 7 or None, text, rng.choice(["en", "en", "en", "fr", None, "und", "zh"]), None, None))
    return out


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least,first", [(12, 2000), (3, 9)])
def test_collocations_equal_brute_force(table, least, first):
    assert got(collocations.collocations(table(rows(), extra=CLASH), least=least, first=first)) == sorted(brute(rows(), least, first))


@pytest.mark.parametrize("bits", [3, 7])
def test_counts_are_exact_though_fingerprints_collide(table, bits):
    few = lambda sums, a, b: collocations.range_hashes(sums, a, b) & np.uint64((1 << bits) - 1)
    assert got(collocations.collocations(table(rows()), least=12, prints=few)) == sorted(brute(rows(), 12, 2000))


def test_a_text_longer_than_a_batch_and_small_files(table, monkeypatch):
    monkeypatch.setattr(collocations, "FILE_KEYS", 7)
    rng = random.Random(1)
    long = " ".join(rng.choice(["red fish", "blue fish", "one", "two.", "three"]) for _ in range(180_000))
    few = [(1, long, "en", None, None), (2, "red fish " * 50, "en", None, None)]
    assert len(long) > 1 << 20
    assert got(collocations.collocations(table(few, files=1), least=100)) == sorted(brute(few, 100, 2000))


def test_nothing_frequent_and_empty_table(table):
    assert got(collocations.collocations(table(), least=10_000)) == []
    assert got(collocations.collocations(table([], SCHEMA, 1))) == []


def test_sql_says_the_same(spark, table):
    import duckdb

    many = rows() * 9
    con = duckdb.connect()
    docs = table(many)
    con.register("documents", docs.toArrow())
    assert got(collocations.collocations(docs)) == sorted(con.sql(collocations.ORACLE_SQL).fetchall())
