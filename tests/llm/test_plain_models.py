"""Quality and language queries against plain models: dictionaries and loops, no batches, no Spark."""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import langid, quality
from pagemill.llm.common import byte_hash, mix

from .conftest import DOCS, SCHEMA
from .test_models import crc, language_rows, quality_rows

KNOWN = [r for r in DOCS if r[0] is not None and r[0] != 8]


def top_bits(h: int, bits: int) -> int:
    return int(mix(np.array([h % (1 << 64)], np.uint64))[0]) >> 64 - bits


def ngram_buckets(text: str | None) -> Counter:
    out = Counter()
    t = f" {text.lower()} " if text else ""
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            h = 0
            for k in range(n):
                h = h * 0x9E3779B97F4A7C15 + ord(t[i + k]) + k + 1
            out[top_bits(h, langid.BITS)] += 1
    return out


def test_langid_is_naive_bayes(table):
    rows = language_rows(90) + [(1000 + i, *r[1:]) for i, r in enumerate(KNOWN) if r[0] != 10]
    count, docs = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if lang is not None and crc(i, 4) != 2:
            docs[lang] += 1
            count[lang].update(ngram_buckets(text))
    want = {}
    for i, text, *_ in rows:
        if not any(map(str.isalpha, text or "")):
            want[i] = ("und", 0.0)
            continue
        logs = {}
        for lang in sorted(docs):
            total = sum(count[lang].values()) + langid.ALPHA * 2**langid.BITS
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((count[lang][b] + langid.ALPHA) / total) for b, n in ngram_buckets(text).items())
        best = max(logs, key=logs.get)
        want[i] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values()))
    got = {r.doc_id: r for r in langid.digest(table(rows, SCHEMA)).collect()}
    assert len(got) == len(want) and {"aa", "bb", "cc", "und"} <= {r.lang_pred for r in got.values()}
    for i, (lang, score) in want.items():
        assert (got[i].lang_pred, got[i].held_out) == (lang, crc(i, 4) == 2) and got[i].score == pytest.approx(score, abs=1e-9), i


def word_buckets(text: str | None) -> Counter:
    tokens = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff \t\n\x0b\x0c\r]+", (text or "").encode())
    one = [int(byte_hash(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    out = Counter(h >> 64 - quality.BITS for h in one)
    out.update(top_bits(a * 3 + b, quality.BITS) for a, b in zip(one, one[1:]))
    for k in range(1, len(one)):
        if one[k] == one[k - 1]:
            out[top_bits(1, quality.BITS)] += 1
        elif k > 1 and one[k] == one[k - 2]:
            out[top_bits(2, quality.BITS)] += 1
    return out


def shares(text: str | None) -> dict[int, float]:
    seen = word_buckets(text)
    return {b: float(np.float32(n * (quality.SCALE / sum(seen.values())))) for b, n in seen.items()}


def test_quality_is_logistic_regression_by_ftrl(spark, table):
    rows, labels = quality_rows(160)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(KNOWN) if r[0] != 10]
    text_of, label_of = {r[0]: r[1] for r in rows}, {i: q for i, q, _ in labels if i in range(160) and q is not None}
    taught = [i for i in label_of if crc(i, 5)]
    shard = {int(r.id): r.s for r in spark.createDataFrame([(str(i),) for i in taught], "id string").select(
        "id", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(quality.SHARDS)).alias("s")).collect()}
    mean = Counter()
    for s in range(quality.SHARDS):
        z, n = Counter(), Counter()

        def weight(b):
            if abs(z[b]) <= quality.L1:
                return 0.0
            return (math.copysign(quality.L1, z[b]) - z[b]) / ((quality.OFFSET + math.sqrt(n[b])) / quality.STEP + quality.L2)

        own = sorted((i for i in taught if shard[i] == s), key=lambda i: int(mix(np.array([xxhash.xxh64_intdigest(str(i), 7)], np.uint64))[0]))
        for _ in range(quality.EPOCHS):
            for i in own:
                x = {**shares(text_of[i]), "bias": 1.0}
                w = {b: weight(b) for b in x}
                miss = 1 / (1 + math.exp(-sum(w[b] * x[b] for b in x))) - label_of[i]
                for b, v in x.items():
                    g = miss * v
                    z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / quality.STEP * w[b]
                    n[b] += g * g
        for b in z:
            mean[b] += weight(b) / quality.SHARDS
    got = {r.doc_id: r for r in quality.digest(table(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(rows) and len({round(r.score, 3) for r in got.values()}) > 20
    for i, text in text_of.items():
        score = 1 / (1 + math.exp(-mean["bias"] - sum(mean[b] * v for b, v in shares(text).items())))
        assert got[i].score == pytest.approx(score, abs=1e-5) and got[i].held_out == (crc(i, 5) == 0), i
