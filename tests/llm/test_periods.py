"""Runs of repeated words against a brute-force search."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import periods

from .conftest import DOCS, prose

CLASH = {"start": "1", "length": "2", "period": "3", "n_runs": "4", "runs": "5", "w": "6"}


def words_as_asked(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_runs(words):
    """(start, length, period) by trying every period everywhere."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            to = at
            while to + q < n and words[to] == words[to + q]:
                to += 1
            if to - at + q >= max(6, 4 * q):
                out.setdefault((at, to + q), q)
            at = max(to, at + 1) if to > at else at + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def brute(doc_id, text):
    words = words_as_asked(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        from fractions import Fraction
        s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows():
    rng = random.Random(4)
    out = list(DOCS)
    for i in range(100, 400):  # a tenth of these ids gets a period
        out.append((i, prose(rng.randrange(1, 120), i % 50), "en", "a", 1))
    for i in range(400, 480):  # words of a small alphabet: many runs, nested ones too
        out.append((i, " ".join(rng.choice("ab"[:1 + i % 2 + 1]) for _ in range(rng.randrange(200))), "en", "a", 1))
    inner = "x x x x x x y " * 5 + "z "
    out += [(500, inner * 5, "en", "a", 1), (501, ("a b " * 9 + "c ") * 6, "en", "a", 1), (502, "w " * 5000, "en", "a", 1), (503, ("p q r s t " * 40).strip() + " " + "p q r s t u " * 30, "en", "a", 1)]
    out += [(504, "\t a\n\x0ba\x0c\ra a a a ", "en", "a", 1), (505, "a a a a a", None, None, None), (506, "a b a b a b a", None, None, None), (507, "a b a b a b a b", None, None, None), (505, "a a a a a", None, None, None)]
    return out


def test_digest_equals_brute_force(table):
    got = Counter(tuple(r) for r in periods.digest(table(rows(), extra=CLASH)).collect())
    assert got == Counter(brute(i, t) for i, t, *_ in rows())


def find(texts, **how):
    counts = np.array([len(t) for t in texts])
    kinds = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    seq, head = periods.sequence(np.array([kinds[w] for t in texts for w in t], np.int64), counts)
    found = periods.find_runs(seq, int(counts.max()), **how)
    return [[(int(a - h), int(b - a), int(q)) for a, b, q in found if h <= a < h + c and b - a >= 6] for h, c in zip(head, counts)]


def test_many_periods_at_all_scales():
    rng = random.Random(9)
    texts = []
    for q in [*range(1, 40), 63, 64, 65, 100, 127, 128, 129, 255]:
        word = [rng.choice("abcdef") + str(rng.randrange(3)) for _ in range(q)]
        whole = word * 7
        for length in {4 * q - 1, 4 * q, 4 * q + 1, 5 * q + q // 2, 7 * q}:
            texts.append([f"u{k}" for k in range(rng.randrange(9))] + whole[:length] + [f"v{k}" for k in range(rng.randrange(9))])
    for _ in range(60):  # words of Fibonacci and Thue-Morse kind, and periodic ones made of them
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(2, 6)):
            a, b = b, b + a
        m = ["a"]
        for _ in range(rng.randrange(1, 6)):
            m = m + ["b" if x == "a" else "a" for x in m]
        texts.append(rng.choice([b * 4, m * 4 + ["a"], (b * 4 + ["c"]) * 4, m * 9]))
    assert find(texts) == [brute_runs(t) for t in texts]


def test_a_long_word_of_thue_morse_kind_four_times():
    m = ["a"]
    for _ in range(12):
        m = m + ["b" if x == "a" else "a" for x in m]
    got = find([["u"] + (m + ["c"]) * 4 + ["v"]])
    assert got == [[(1, 4 * len(m) + 4, len(m) + 1)]]


def test_colliding_range_hashes_add_and_hide_nothing():
    rng = random.Random(2)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(9, 90))] for _ in range(30)] + [["a", "b", "c", "a", "d"] * 6 + ["x"] * 9]

    def half_blind(seq):  # two words look alike to the hashes, so stretches seem longer than they are
        return periods.word_sums(np.where(seq == 2, 1, seq))

    for t, own in zip(texts, find(texts, hashes=half_blind)):
        assert set(own) <= set(brute_runs(t))


def test_a_text_longer_than_a_batch(table, monkeypatch):
    text = ("one two three four five six seven " * 33_000 + "end") + " tail of words" * 3
    out = periods.periodic_runs(table([(1, text), (2, "a b c"), (3, None)], "doc_id long, text string", 1)).collect()
    got = {r.doc_id: ([tuple(x) for x in r._pr_runs], bytes(r._pr_rest).decode(), r._pr_words) for r in out}
    assert len(text) > periods.SLICE_BYTES
    assert got == {1: ([(0, 231_000, 7)], "one two three four five six seven end" + " tail of words" * 3, 231_010), 2: ([], "a b c", 3), 3: ([], "", 0)}


def test_empty_table_and_taken_names(spark, table):
    assert periods.digest(table([], "doc_id long, text string", 1)).collect() == []
    with pytest.raises(ValueError):
        periods.periodic_runs(table(extra={"_pr_runs": "1"}))
