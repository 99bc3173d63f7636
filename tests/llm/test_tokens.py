"""BPE, packing, shards and the pipeline against the tokenizers library and brute force."""
from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe, packing, shards
from pagemill.llm.queries import ORACLE, QUERIES

from .conftest import DOCS, SCHEMA, prose
from .test_dedup import CLASH

PIECES = ["a", "B", "'s", "'", "'LL", "  ", "\n", "\t", " ", "é", "ß", "1", "²", "<|endoftext|>", "!!", "日本", "　", "\x1c", "\x85", "\xa0", "😀", "ﬁ", "٣", "é", "​", "<|", "|>"]


@pytest.fixture(scope="module")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def binary(ids):
    return np.asarray(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PIECES), max_size=40), cut=st.integers(1, 9))
def test_encoding_whole_and_in_joined_parts(library, tokenizer_path, parts, cut):
    text, coder = "".join(parts), bpe.load(tokenizer_path)
    want = ids_of(library, text)
    assert coder.encode(text) == binary(want)
    assert coder.decode(binary(want)) == library.decode(want, skip_special_tokens=False)
    level = [coder.units(p) for p in coder.cut(text, cut)]
    while len(level) > 1:
        level = [coder.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert coder.ids(level[0] if level else []) == binary(want)


@pytest.mark.parametrize("leaf", [3, 7, 64])
def test_tree_of_unsplit_text(library, tokenizer_path, leaf):
    rng, coder = random.Random(leaf), bpe.Bpe(tokenizer_path, leaf)
    texts = ["".join(rng.choice("theingostrand") for _ in range(rng.randrange(400))) for _ in range(60)]
    for text in [*texts, "a" * 3000, "ab" * 999, " " * 500, "é" * 700, "=-" * 800, "日本語" * 200]:
        assert coder.encode(text) == binary(ids_of(library, text))


@pytest.mark.parametrize("spread_chars", [50, 1 << 20])
def test_bpe_digest(table, library, tokenizer_path, spread_chars):
    got = Counter(tuple(r) for r in bpe.digest(table(extra=CLASH | {"ids": "1"}), tokenizer_path, spread_chars).collect())
    want = Counter()
    for i, t, *_ in DOCS:
        ids = ids_of(library, t)
        want[i, len(ids), hashlib.sha256(binary(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_bpe_refuses_a_clashing_output_column(table, tokenizer_path):
    with pytest.raises(ValueError):
        bpe.encode(table(extra={"ids": "1"}), "text", tokenizer_path, "ids")


# -- packing ---------------------------------------------------------------

def test_pieces_are_cut_where_texts_are_encoded(table, tokenizer_path):
    """No second Python worker behind the encoder's: the rows of short and long texts meet last."""
    plan = packing.pieces(table(), tokenizer_path)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"

@settings(max_examples=150, deadline=None)
@given(lengths=st.lists(st.integers(1, 30), max_size=120))
def test_plan_uses_every_piece_once(lengths):
    plan = packing.plan(Counter(lengths), 30)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 30 and times > 0
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths)
    least = -(-sum(lengths) // 30)
    first_fit: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = next((k for k, s in enumerate(first_fit) if s + x <= 30), None)
        if at is None:
            first_fit.append(x)
        else:
            first_fit[at] += x
    assert least <= sum(t for _, t in plan) <= len(first_fit) + 1


def test_plan_finds_exact_complements():
    assert sorted(packing.plan({20: 1, 10: 1, 15: 1, 9: 1, 6: 1, 12: 1, 8: 1, 7: 1, 3: 1}, 30)) == sorted([((20, 10), 1), ((15, 12, 3), 1), ((9, 8, 7, 6), 1)])


def scanned_plan(counts, capacity):
    """The plan by trying all combinations for every gap: no tables."""
    left, out = Counter(counts), []

    def fill(gap):
        if left[gap] > 0:
            return (gap,)
        for a in range(gap - 1, 0, -1):
            if a >= gap - a and left[a] > (a == gap - a) and left[gap - a] > 0:
                return (a, gap - a)
        for a in range(gap - 2, 0, -1):
            for b in range(min(a, gap - a - 1), 0, -1):
                c = gap - a - b
                if c <= b and all(left[x] >= n for x, n in Counter((a, b, c)).items()):
                    return (a, b, c)
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            found = fill(capacity - length) if length < capacity else ()
            left[length] += 1
            if found is None:
                break
            need = Counter((length, *found))
            times = min(left[x] // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
            out.append(((length, *found), times))
    return out + packing.best_fit({x: n for x, n in left.items() if n}, capacity)


@settings(max_examples=300, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=40), capacity=st.sampled_from([40, 41]))
def test_plan_by_tables_is_the_one_found_by_trying_all(counts, capacity):
    assert packing.plan(counts, capacity) == scanned_plan(counts, capacity)


@settings(max_examples=100, deadline=None)
@given(lengths=st.sets(st.integers(1, 40), max_size=40))
def test_sum_tables(lengths):
    have = np.array(sorted(lengths), int)
    pairs = packing.pair_sums(have, 40) if lengths else {}
    want = {}
    for a in sorted(lengths, reverse=True):
        for b in lengths:
            if b <= a and a + b < 40:
                want.setdefault(a + b, []).append(a)
    assert {k: v.tolist() for k, v in pairs.items()} == want
    triples = {k: v.tolist() for k, v in packing.triple_sums(have, pairs, 40).items()}
    sums = {}
    for a in sorted(lengths, reverse=True):
        for total in {a + b + c for b in lengths for c in lengths if c <= b <= a and a + b + c < 40}:
            sums.setdefault(total, []).append(a)
    assert triples == sums


def test_spent_combinations_leave_the_tables():
    supply = packing.Supply({5: 1, 4: 1, 3: 2, 2: 1, 1: 2}, 20)
    assert supply.pair(7) == (5, 2) and supply.take((5, 2)) == 1
    assert supply.pair(7) == (4, 3) and supply.pairs[7].tolist() == [4]
    assert supply.pair(6) == (3, 3) and supply.pair(6, aside=(3,)) is None
    assert supply.triple(8) == (4, 3, 1) and supply.take((4, 3, 1)) == 1
    assert supply.pair(7) is None and 7 not in supply.pairs and supply.triple(8) is None


def test_plan_of_many_lengths_makes_few_look_ups(monkeypatch):
    rng, calls = random.Random(5), Counter()
    for name in ("pair", "triple"):
        def counted(self, *args, _of=getattr(packing.Supply, name), _name=name, **kw):
            calls[_name] += 1
            return _of(self, *args, **kw)
        monkeypatch.setattr(packing.Supply, name, counted)
    lengths = Counter(rng.randrange(1, packing.CAPACITY) for _ in range(20_000))
    plan = packing.plan(lengths)
    assert calls["pair"] < 200_000 and calls["triple"] <= len(plan)


def test_packing_digest(table, library, tokenizer_path):
    got = packing.digest(table(extra=CLASH | {"length": "5", "start": "6"}), tokenizer_path).collect()
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // packing.CAPACITY)
    for _, rows in groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    want = Counter()
    for i, t, *_ in DOCS:
        ids = np.array([*ids_of(library, t), 0], "<u4")
        first = (len(ids) - 1) % packing.CAPACITY + 1
        edges = [0, *range(first, len(ids) + 1, packing.CAPACITY)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.digest(table([], SCHEMA, 1), tokenizer_path).collect() == []


# -- shards ----------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    out = shards.permute(np.arange(n), n, 5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 60 or (out != shards.permute(np.arange(n), n, 6)).mean() > 0.9 and (out == np.arange(n)).mean() < 0.1


def test_shards_hold_every_token_in_keyed_order(table, library, tokenizer_path, tmp_path):
    docs = table(extra=CLASH | {"index": "1", "slot": "2"})
    rows = shards.write(docs, tokenizer_path, f"file://{tmp_path}/out", length=64, shard_slots=100).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    streams: dict[int, list] = {}
    ends = []
    for r in rows:
        raw = (tmp_path / "out" / f"shard-{r.shard:06d}.bin").read_bytes()[r.offset:r.offset + 128]
        assert zlib.crc32(raw) == r.crc32
        streams[r.sequence_index] = np.frombuffer(raw, "<u2")[:r.n_tokens].tolist()
        ends.append(r.n_tokens < 64)
    sizes = Counter(r.shard for r in rows)
    assert all((tmp_path / "out" / f"shard-{s:06d}.bin").stat().st_size == 128 * n for s, n in sizes.items())
    tokens = [x for k in sorted(streams) for x in streams[k]]
    have = Counter(tuple(g) for end, g in groupby(tokens, key=lambda x: x == shards.END_ID) if not end)
    special = lambda ids: [tuple(g) for end, g in groupby(ids, key=lambda x: x == shards.END_ID) if not end]
    assert have == Counter(x for _, t, *_ in DOCS for x in special(ids_of(library, t)))
    assert tokens.count(shards.END_ID) == len(DOCS) + sum(ids_of(library, t).count(shards.END_ID) for _, t, *_ in DOCS)
    assert [r.sequence_index for r in rows] != sorted(streams)


def test_reading_goes_on_at_any_position(table, tokenizer_path, tmp_path):
    to = f"file://{tmp_path}/out"
    manifest = shards.keep_manifest(shards.write(table(), tokenizer_path, to, length=64, shard_slots=100), to)
    rows = sorted(manifest.collect(), key=lambda r: r.position)
    raw = {s: (tmp_path / "out" / f"shard-{s:06d}.bin").read_bytes() for s in {r.shard for r in rows}}
    want = [(r.position, r.n_tokens, raw[r.shard][r.offset:r.offset + 128]) for r in rows]
    for at in (0, 1, len(rows) // 2, len(rows) - 1, len(rows)):
        got = shards.read(manifest, to, tokenizer_path, at, length=64, stretch=7).collect()
        assert sorted((r.position, r.n_tokens, bytes(r.ids)) for r in got) == want[at:]
    torn = rows[0]
    with open(tmp_path / "out" / f"shard-{torn.shard:06d}.bin", "r+b") as f:
        f.seek(torn.offset)
        f.write(bytes(x ^ 255 for x in raw[torn.shard][torn.offset:torn.offset + 2]))
    assert len(shards.read(manifest, to, tokenizer_path, 1, length=64).collect()) == len(rows) - 1
    with pytest.raises(Exception, match="not the record that was written"):
        shards.read(manifest, to, tokenizer_path, length=64).collect()


def test_shards_of_nothing(table, tokenizer_path, tmp_path):
    assert shards.write(table([], SCHEMA, 1), tokenizer_path, f"file://{tmp_path}/out").collect() == []


# -- the pipeline and the registry -----------------------------------------
def test_pipeline_equals_its_stages_by_hand(spark, tmp_path, tokenizer_path):
    import corpus_pipeline

    junk = [(500 + i, "!! ".join(prose(40, i).upper().split()), "en", "z", 0) for i in range(60)]
    good = [(600 + i, prose(60, 900 + i), "en", "z", 0) for i in range(160)]
    rows = DOCS + junk + good
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, 0) for i, *_ in junk] + [(i, 1, 0) for i, *_ in good]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r.doc_id for r in out}
    assert not left & {i for i, *_ in junk} and {i for i, *_ in good} <= left
    assert 1 not in left and 2 not in left and 3 in left  # the longest of equal texts stays
    assert len(left & {4, 5, 6}) == 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(f"{tmp_path}/stage-{k}")
            docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
    piece = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, docs.collect())) == Counter(map(piece, out))


def test_one_query_for_each_operator():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, table, name, tmp_path):
    import duckdb

    from .test_models import vectors

    spark.createDataFrame([d for d in DOCS if d[0] != 8], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    page = "<p>" + "one page twice " * 10
    pages = [(3, "a", page), (1, "b", page), (2, "c", "short"), (4, "d", "short"), (5, "e", None), (6, "f", page + "é")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for t in ("documents", "embeddings", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duckdb.sql(ORACLE[name])
    order = sorted(want.columns)
    got = QUERIES[name](spark, str(tmp_path)).select(order).collect()
    at = [want.columns.index(c) for c in order]
    assert Counter(map(tuple, got)) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
