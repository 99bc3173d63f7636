"""Quality, language, language model and top-k against brute force or held-out rows."""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import langid, lm, quality, topk

from .conftest import DOCS, SCHEMA, prose
from .test_dedup import CLASH


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# -- quality ---------------------------------------------------------------
def quality_rows(n=400):
    good = lambda i: prose(20 + i % 50, i)
    bad = [lambda i: "!! ".join(prose(30, i).upper().split()), lambda i: " | ".join(prose(30, i).split()), lambda i: "same " * 60]
    rows = [(i, good(i) if i % 4 else bad[i // 4 % 3](i), None, None, None) for i in range(n)]
    return rows, [(i, int(bool(i % 4)), 0) for i in range(n) if i % 10 != 3] + [(None, 1, 0), (5, None, None), (10**9, 1, 1)]


def test_quality_held_out_accuracy(spark, table):
    rows, labels = quality_rows()
    docs = table(rows + [(None, None, None, None, None), (9000, "", None, None, None)], SCHEMA, extra=CLASH)
    out = quality.digest(docs.drop("score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + 2
    test = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.held_out]
    assert len(test) > 50 and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in test)
    assert np.mean([r.predicted == int(bool(r.doc_id % 4)) for r in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in out)


def test_quality_does_not_see_ids_or_held_out_labels(spark, table):
    rows, labels = quality_rows(200)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q if i is None or crc(i, 5) or q is None else 1 - q, t) for i, q, t in labels]
    a, b = (quality.digest(table(rows, SCHEMA, 2), spark.createDataFrame(x, schema)).collect() for x in (labels, flipped))
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_quality_without_labels(spark, table):
    out = quality.digest(table(), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in out} == {0.5} and len(out) == len(DOCS)


def test_features_do_not_depend_on_the_batch():
    texts = [t.encode() for _, t, *_ in DOCS if t]
    def feats(ts):
        raw, off = np.frombuffer(b"".join(ts), np.uint8), np.cumsum([0, *map(len, ts)])
        buckets, counts = quality.features(raw, off)
        return [sorted(x.tolist()) for x in np.split(buckets, np.cumsum(counts)[:-1])]
    assert feats(texts) == [feats([t])[0] for t in texts]


# -- language --------------------------------------------------------------
SYLLABLES = {"aa": "ka ro mi ti lu", "bb": "sch pf ung ein ach", "cc": "eau oux tre que èle"}


def language_rows(n=240):
    import random

    rng = random.Random(5)
    names = sorted(SYLLABLES)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[names[i % 3]].split()) for _ in range(3)) for _ in range(4 + i % 30)), names[i % 3], None, None) for i in range(n)]


def test_langid(table):
    rows = language_rows() + [(1000, None, "aa", None, None), (1001, "123 !? ²", "aa", None, None), (1002, "", None, None, None), (None, "karomi", "aa", None, None)]
    out = {r.doc_id: r for r in langid.digest(table(rows, extra=CLASH)).collect()}
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    for i, _, lang, *_ in language_rows():
        assert out[i].lang_pred == lang and out[i].held_out == (crc(i, 4) == 2) and 0 <= out[i].score <= 1


def test_langid_counts_every_ngram():
    texts = ["Abc é", "", None, "x" * 500, "日本"]
    buckets, counts = langid.grams(texts)
    sizes = [sum(max(0, len(t) + 2 - n + 1) for n in langid.SIZES) if t else 0 for t in texts]
    assert counts.tolist() == sizes and len(buckets) == sum(sizes)
    alone = np.concatenate([langid.grams([t])[0] for t in texts])
    assert Counter(alone.tolist()) == Counter(buckets.tolist())


def test_langid_with_nothing_to_learn(table):
    assert {r.lang_pred for r in langid.digest(table([(1, "abc", None, None, None)], SCHEMA, 1)).collect()} == {"und"}
    assert langid.digest(table([], SCHEMA, 1)).collect() == []


# -- language model --------------------------------------------------------
def brute_lm(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    texts = [(i, split(t)) for i, t, *_ in rows]
    one, two = Counter(), Counter()
    for i, x in texts:
        if i is not None and crc(i, 7) != 2:
            one.update(x)
            two.update(zip([None, *x[:-1]], x))
    n, v, left = sum(one.values()), len(one), Counter(w for _, w in two)
    d2, d1 = (lm.discounts(np.array([Counter(c.values())[k] for k in (1, 2, 3, 4)])) for c in (two, left))
    back = defaultdict(float)
    for (u, _), c in two.items():
        back[u] += d2[min(c, 3)]
    rest = sum(d1[min(c, 3)] for c in left.values())
    for i, x in texts:
        base = full = 0.0
        for u, w in zip([None, *x[:-1]], x):
            p = max(left[w] - d1[min(left[w], 3)], 0) / len(two) + rest / len(two) / (v + 1)
            if one[u]:
                p = (max(two[u, w] - d2[min(two[u, w], 3)], 0) + back[u] * p) / one[u]
            full += math.log10(p)
            base += math.log10((one[w] + 1) / (n + v + 1))
        yield i, len(x), sum(one[w] > 0 for w in x), n, base, full


@pytest.mark.parametrize("small", [False, True])
def test_lm(table, monkeypatch, small):
    if small:  # many ranges, many flushes
        for name, value in (("WORD_BYTES", 3000), ("PAIR_BYTES", 2000), ("FLUSH_KEYS", 500)):
            monkeypatch.setattr(lm, name, value)
    rows = DOCS + [(100 + i, prose(60 + i, i), "en", None, None) for i in range(40)] + [(200, "the " * 900, "en", None, None)]
    got = lm.digest(table(rows, extra=CLASH)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[4], 6), round(r[5], 4))
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(have, sorted(brute_lm(rows), key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-6)
    assert all(r.held_out == (crc(r.doc_id, 7) == 2) for r in got if r.doc_id is not None)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def brute_lm_of(rows, order):
    """Interpolated modified Kneser-Ney by dictionaries of tuples; an n-gram at a text's head has nothing before it."""
    split = lambda t: ["<s>"] + re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"]
    texts = [(i, split(t)) for i, t, *_ in rows]
    raw = {n: Counter(tuple(x[j:j + n]) for i, x in texts if i is not None and crc(i, 7) != 2 for j in range(len(x) - n + 1)) for n in range(1, order + 1)}
    adjusted = {order: raw[order]}
    for n in range(1, order):
        lefts = Counter(g[1:] for g in raw[n + 1])
        adjusted[n] = {g: c if n > 1 and g[0] == "<s>" else lefts[g] for g, c in raw[n].items() if g != ("<s>",)}
    off = {n: lm.discounts(np.array([Counter(c.values())[k] for k in (1, 2, 3, 4)])) for n, c in adjusted.items()}
    total, back = defaultdict(float), defaultdict(float)
    for n, c in adjusted.items():
        for g, k in c.items():
            total[g[:-1]] += k
            back[g[:-1]] += off[n][min(k, 3)]
    n_words = len(adjusted[1])

    def p(g):
        if not g:
            return 1 / (n_words + 1)
        if not total[g[:-1]]:
            return p(g[1:])
        k = adjusted[len(g)].get(g, 0)
        return (max(k - off[len(g)][min(k, 3)], 0) + back[g[:-1]] * p(g[1:])) / total[g[:-1]]

    return sorted((str(i), len(x) - 1, round(sum(math.log10(p(tuple(x[max(0, j - order + 1):j + 1]))) for j in range(1, len(x))), 3)) for i, x in texts)


@pytest.mark.parametrize("order,small", [(2, False), (3, False), (3, True), (4, True)])
def test_lm_counts_longer_contexts(table, monkeypatch, order, small):
    if small:  # many ranges, many flushes
        for name, value in (("WORD_BYTES", 3000), ("PAIR_BYTES", 2000), ("FLUSH_KEYS", 500)):
            monkeypatch.setattr(lm, name, value)
    rows = DOCS + [(100 + i, " ".join(prose(400, 1).split()[i:i + 40 + i]), "en", None, None) for i in range(40)] + [(200, "the the " * 900, "en", None, None)]
    have = sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in lm.digest(table(rows, extra=CLASH), order=order).collect())
    for a, b in zip(have, brute_lm_of(rows, order), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-3, rel=1e-6)


def test_lm_query_scores_by_trigrams(spark, table, monkeypatch):
    from pagemill.llm import queries

    rows = DOCS + [(100 + i, prose(60 + i, 1), "en", None, None) for i in range(40)]
    docs = table(rows)
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    have = sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in queries.QUERIES["op8_lm"](spark, "").collect())
    for a, b in zip(have, brute_lm_of(rows, 3), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-3, rel=1e-6)


def test_lm_of_empty_texts(table):
    train, held = [i for i in range(99) if crc(i, 7) != 2][:3], next(i for i in range(99) if crc(i, 7) == 2)
    rows = [(i, "", None, None, None) for i in train] + [(held, "a b", None, None, None)]
    have = sorted((str(r.doc_id), r.n_tokens, round(r.score, 3)) for r in lm.digest(table(rows, SCHEMA, 1), order=3).collect())
    assert [x[:2] for x in have] == [x[:2] for x in brute_lm_of(rows, 3)]
    assert [x[2] for x in have] == pytest.approx([x[2] for x in brute_lm_of(rows, 3)], abs=2e-3)


def test_lm_counts_are_not_cut(tmp_path):
    keys, times = np.array([5, 9], np.uint64), np.array([3, (1 << 32) + 7])
    lm._save_counts(str(tmp_path), "left1-0", times)
    parcel = list(lm._parcels(keys, times, np.zeros(1, np.uint64)))
    assert lm._merged(iter(parcel + parcel))[2].tolist() == (2 * times).tolist()
    model = lm.Model(str(tmp_path), 2, 0, [lm.Level(np.zeros(1, np.uint64), np.array([0, 2]))])
    assert lm.Reader(model).of(1, "left1", "u1", np.array([0, 1])).tolist() == times.tolist()


def test_lm_without_training_rows(table):
    held = next(i for i in range(99) if crc(i, 7) == 2)
    out = lm.digest(table([(held, "a b", None, None, None)], SCHEMA, 1)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in out] == [(3, 0, 0)]
    assert lm.digest(table([], SCHEMA, 1)).collect() == []


# -- top-k -----------------------------------------------------------------
def vectors(n=500, dims=12, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dims).astype(np.float32).tolist(), 0) for i in range(n)]
    rows += [(n + k, rows[7][1], 0) for k in range(40)] + [(100, rows[100][1], 1), (900, [0.0] * dims, 0)]
    rows += [(600, None, 0), (700, [None] * dims, 0), (800, [math.nan] * dims, 0), (1000, [math.inf] + [0.1] * (dims - 1), 0), (None, [0.1] * dims, 0), (1100, [0.5, 0.25], 0), (1101, [-0.5, 1.0], 0), (1200, [], 0)]
    return rows


def brute_topk(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return Counter(out)


@pytest.mark.parametrize("block_rows,query_rows,resolve", [(64, 3, 0), (10_000, 10_000, 0), (128, 10_000, 20)])
def test_topk(spark, table, monkeypatch, block_rows, query_rows, resolve):
    monkeypatch.setattr(topk, "RESOLVE_ROWS", resolve)
    df = table(vectors(), "vec_id long, embedding array<float>, label int", 2, extra={"score": "1", "rank": "2"})
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block_rows=block_rows, query_rows=query_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_topk(vectors())


def test_topk_few_rows(table):
    schema = "vec_id long, embedding array<float>, label int"
    assert topk.digest(table([], schema, 1)).collect() == []
    assert topk.digest(table([(100, [1.0], 0)], schema, 1)).collect() == []
