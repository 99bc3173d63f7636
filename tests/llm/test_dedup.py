"""Exact, SimHash and repeated-passage dedup against brute force."""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import exact_dedup, simhash, suffix
from pagemill.llm.common import with_rid
from pagemill.llm.components import components

from .conftest import DOCS, SCHEMA, prose

CLASH = {"keep_id": "1", "n": "2", "a": "3", "b": "4", "_id": "5", "rid": "6", "task": "7", "ah": "8", "fp": "9", "piece": "0", "score": "0"}


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    out = []
    for (i, t, *_), n in zip(rows, norm):
        group = [r for r, m in zip(rows, norm) if m == n]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out.append((i, keep[0], len(group), hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hash_fn", [exact_dedup.content_hash, lambda t: F.length(t).cast("string")])
def test_exact_dedup_even_where_all_hashes_of_a_length_collide(table, hash_fn):
    out = exact_dedup.exact_dedup(table(extra=CLASH), hash_fn=hash_fn).collect()
    sha = {r.text: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest() for r in out}
    assert Counter((r.doc_id, r._xd_keep_id, r._xd_size, sha[r.text]) for r in out) == brute_exact(DOCS)
    kept = Counter(sha[r.text] for r in out if r._xd_kept)
    assert set(kept.values()) == {1} and len(kept) == len({k[3] for k in brute_exact(DOCS)})


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_digest(table):
    out = simhash.digest(table(extra=CLASH)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{brute_fp(t):016x}") for i, t, *_ in DOCS)
    fp = [brute_fp(t) for _, t, *_ in DOCS]
    label = list(range(len(DOCS)))
    for _ in DOCS:
        label = [min(label[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(fp))]
    least = {k: min((DOCS[i][0] for i in range(len(DOCS)) if label[i] == k and DOCS[i][0] is not None), default=None) for k in set(label)}
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((DOCS[i][0], least[label[i]]) for i in range(len(DOCS)))


def test_heavy_prefixes_are_split_below_their_first_bits(spark):
    """Fingerprints of one 40-bit prefix: no subtree holds more than it may, and no link is lost."""
    rng = np.random.default_rng(5)
    hot = (np.uint64(0xABCDEF0123 << 24) | rng.integers(0, 1 << 24, 1500, np.uint64))
    values = np.unique(np.concatenate([hot, hot[:200] ^ np.uint64(1 << 63), rng.integers(0, 1 << 63, 100, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "_sh_fp long")
    starts, depths = simhash._subtrees(fps, 50, 8)
    sizes = np.diff(np.append(np.searchsorted(values, starts), len(values)))
    assert sizes.sum() == len(values) and 0 < sizes.min() and sizes.max() <= 50 and depths.max() > 40
    root = {int(v): int(v) for v in values.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, v in enumerate(values):
        for w in values[k + 1:][np.bitwise_count(values[k + 1:] ^ v) <= 4]:
            a, b = sorted((find(int(v.view(np.int64))), find(int(w.view(np.int64)))))
            root[b] = a
    got = {r.node: r.root for r in components(simhash.trie_links(fps, 4, 50, 8)).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


@pytest.mark.parametrize("node_fps", [1, 40, 10_000])
def test_trie_join_finds_all_links_in_any_dealing(spark, node_fps):
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for s in seeds for k in (1, 2, 4, 5, 6)]
    values = np.unique(np.concatenate([seeds, np.array(near, np.uint64), np.arange(50, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "_sh_fp long")
    got = {r.node: r.root for r in components(simhash.trie_links(fps, 4, node_fps)).collect()}
    label = np.arange(len(values))
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    for _ in range(len(values)):
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    groups = lambda of: Counter(tuple(sorted(g)) for g in of.values() if len(g) > 1)
    want, have = {}, {}
    for v, k in zip(values.view(np.int64).tolist(), label.tolist()):
        want.setdefault(k, []).append(v)
        have.setdefault(got.get(v, v), []).append(v)
    assert groups(have) == groups(want)


def test_components_of_a_long_chain_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_simhash_stage_keeps_one_of_each_component(spark, table):
    docs = table()
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert out.count() == simhash.simhash_groups(docs).where("_sh_kept").count() == simhash.simhash_groups(docs).select("_sh_component").distinct().count()


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


def test_suffix_digest(table):
    got = Counter(tuple(r) for r in suffix.digest(table(extra=CLASH)).collect())
    assert got == Counter((i, *x) for (i, *_), x in zip(DOCS, brute_repeats([t for _, t, *_ in DOCS], 200)))


@pytest.mark.parametrize("split", [2, 100_000])
def test_suffix_windows_with_short_strings(table, split, monkeypatch):
    import random

    rng = random.Random(3)
    passage = prose(9, 11)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for _ in range(40)]
    texts += [prose(rng.randrange(6), rng.randrange(99)) + passage + prose(rng.randrange(6), rng.randrange(99)) for _ in range(30)] + ["a" * 150, None, ""]
    docs = table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string", 4)
    out = suffix.remove_repeats(docs, length=24, gram=8, split=split).collect()
    got = {r.doc_id: (len(r._sx_kept), len(r._sx_runs), hashlib.sha256(r._sx_kept).hexdigest()) for r in out}
    want = {i: (n - gone, spans, sha) for i, (n, gone, spans, sha) in enumerate(brute_repeats(texts, 24))}
    assert got == want


def test_suffix_long_text_in_pieces(table, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE_BYTES", 700)
    pieces = [prose(400, 5), prose(50, 6) + prose(200, 5)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"_sx_rid": pa.array([0, 1]), "_sx_text": pa.array(pieces)})
    found = set()
    for rid, base, raw, off in suffix._pieces(iter([batch]), 200):
        a = suffix.anchors(raw, off)
        for row, start, wins in zip(a["row"], a["start"], a["wins"]):
            found |= {(int(rid[row]), int(start + base[row] + k)) for k in range(wins)}
    assert found == {(r, i) for r, p in enumerate(pieces) for i in range(len(p.encode()) - 199)}


def test_empty_tables(spark, table):
    none = table([], SCHEMA, 1)
    for digest in (exact_dedup.digest, simhash.digest, suffix.digest):
        assert digest(none).collect() == []


def test_suffix_stage_keeps_whole_characters(spark, table):
    docs = table([(1, "é" * 150 + "x", "fr", "a", 151), (2, "é" * 150, "fr", "a", 150), (3, None, None, None, 4)])
    out = {r.doc_id: (r.text, r.n_chars) for r in suffix.stage(spark, docs, "").collect()}
    assert out == {1: ("x", 1), 2: ("", 0), 3: (None, None)}


@pytest.fixture
def scans(spark, table):
    """A table in a session of its own, and a function that sets how parallel later scans would be."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", "1")
    rows = [(i, prose(60, i % 40), "en", None, None) for i in range(120)]
    docs = own.read.schema(SCHEMA).parquet(table(rows, files=8).inputFiles()[0].rsplit("/", 1)[0])
    cores = lambda n: own.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
    cores(2)
    return docs, rows, cores


def test_two_scans_number_rows_alike_though_executors_come_and_go(scans):
    docs, _, cores = scans
    first = Counter(map(tuple, with_rid(docs).select("doc_id", "_rid").collect()))
    cores(7)
    assert Counter(map(tuple, with_rid(docs).select("doc_id", "_rid").collect())) == first


@pytest.mark.parametrize("stage", [exact_dedup.stage, simhash.stage])
def test_stages_keep_the_right_rows_though_executors_come_and_go(scans, stage):
    docs, rows, cores = scans
    out = stage(docs.sparkSession, docs, "")
    cores(7)  # the texts are scanned again only now
    kept = out.collect()
    assert Counter(r.text for r in kept) == Counter({t for _, t, *_ in rows}) and {r.doc_id for r in kept} == set(range(40))


@pytest.mark.parametrize("length", [8, 24, 40])
def test_interleave_of_shards_equals_one_sort_of_all(length, monkeypatch):
    rng = np.random.default_rng(length)
    rows = sorted((int(rng.integers(3)), int(rng.integers(6)), bytes(rng.integers(97, 99, length - 4).astype(np.uint8)) + bytes(rng.integers(97, 99, 4).astype(np.uint8))) for _ in range(700))
    block, shard = (np.array([r[k] for r in rows]) for k in (0, 1))
    text = np.array([np.frombuffer(r[2], np.uint8) for r in rows])
    lcp = np.zeros(len(rows), np.int64)
    inside = np.flatnonzero((block[1:] == block[:-1]) & (shard[1:] == shard[:-1])) + 1
    lcp[inside] = suffix.shared_bytes(text[inside], text[inside - 1])
    order, common = suffix.interleave(block, shard, lcp, np.ascontiguousarray(text).view(">u8").astype(np.uint64))
    want = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][2], rows[i][1], i))
    assert order.tolist() == want
    for k in range(1, len(rows)):
        a, b = rows[want[k - 1]], rows[want[k]]
        assert common[k] == (next((i for i in range(length) if a[2][i] != b[2][i]), length) if a[0] == b[0] else 0)


def test_suffix_many_shards_and_few_rows_at_once(table, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE_BYTES", 300)
    monkeypatch.setattr(suffix, "MERGE_ROWS", 5)
    texts = [prose(30, i % 7) + " " + prose(20, i % 5) + prose(10, i) for i in range(60)]
    docs = table([(i, t) for i, t in enumerate(texts)], "doc_id long, text string", 5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.digest(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))
