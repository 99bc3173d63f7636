"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

Distinct fingerprints form a binary trie. The join starts at the pair (root,
root) and goes down both tries at once: a pair of nodes whose paths differ in
d bits splits into its children's pairs, those that branch differently with
d + 1, and is dropped as soon as d exceeds the budget. Pairs of single
fingerprints are compared by their remaining bits.

The upper levels are dealt out: subtrees of at most ``node_fps`` fingerprints
(or of four 65,536ths of all, where that is more) are found from prefix counts,
which go on under those prefixes alone that hold more, and each pair of subtrees
within the budget is a task. A task returns a spanning forest of its links, never
all pairs, and the forests' components are found by joins.

Defined results: a null or empty text has fingerprint zero; a null id is never
a component's name unless it has no other; repeated rows share a fingerprint;
an empty table gives no rows; internal names begin with ``_sh_``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import materialise, pick, slices, squeeze, unsqueeze, with_rid
from pagemill.llm.components import components

#: Words in a shingle.
WORDS = 4
#: Most differing bits of linked fingerprints.
MAX_BITS = 4
#: Fingerprints in a subtree that is one side of a task.
NODE_FPS = 1 << 14
#: The driver takes at most 2**COUNT_BITS prefix counts at a time.
COUNT_BITS = 16
#: Subtrees whose neighbours a dealing task remembers.
REMEMBERED = 1 << 12
#: By depth, the bits of a path.
PATH = np.array([(1 << 64) - (1 << 64 - d) for d in range(65)], np.uint64)
#: Node pairs expanded at once, and links kept before they are reduced to a forest.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash over word shingles, repeats included."""
    parts = text.lower().split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    if len(parts) <= words:
        spans = [(0, len(flat))]
    else:
        spans = zip([0, *(ends[:len(parts) - words] + 1).tolist()], ends[words - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], 42) for a, b in spans], ">u8")
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str, words: int = WORDS) -> DataFrame:
    """``docs`` without its text, plus ``_sh_fp`` (the 64 bits as a signed long)."""
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            fps = np.array([fingerprint(t or b"", words) for t in pick(batch, text_col).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(pick(batch, f.name) for f in rest), pa.array(fps.view(np.int64))], names=[*(f.name for f in rest), "_sh_fp"])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("_sh_fp", T.LongType())]))


class Trie:
    """Binary trie over sorted distinct 64-bit values; children by level."""

    def __init__(self, values: np.ndarray, depth: int = 0):
        self.values, self.top = values, depth
        self.levels = []
        first = np.zeros(1, np.int64) if depth == 0 else np.flatnonzero(np.concatenate([[True], (values[1:] ^ values[:-1]) >> np.uint64(64 - depth) != 0]))
        self.first = first  # of each node of the top level, its first value
        while True:
            size = np.diff(np.append(first, len(values)))
            self.levels.append((size == 1, first.astype(np.int32)))
            if depth == 64 or (size == 1).all():
                break
            # a value starts a node of the next level where its first depth + 1 bits change
            starts = np.flatnonzero(np.concatenate([[True], (values[1:] ^ values[:-1]) >> np.uint64(63 - depth) != 0])) if len(values) > 1 else np.zeros(1, np.int64)
            owner = np.searchsorted(first, starts, side="right") - 1
            bit = (values[starts] >> np.uint64(63 - depth)) & np.uint64(1)
            child = np.full((2, len(first)), -1, np.int32)
            child[bit.astype(np.int64), owner] = np.arange(len(starts), dtype=np.int32)
            self.levels[-1] += (child,)
            first, depth = starts, depth + 1

    def pairs(self, i: np.ndarray, j: np.ndarray, differ: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of value positions, under the given pairs of top nodes, within the budget."""
        stack = [(0, i, j, differ)]
        while stack:
            level, i, j, d = stack.pop()
            if len(i) > CHUNK:
                stack += [(level, i[CHUNK:], j[CHUNK:], d[CHUNK:])]
                i, j, d = i[:CHUNK], j[:CHUNK], d[:CHUNK]
            single, first = self.levels[level][:2]
            done = single[i] & single[j]
            if done.any():
                a, b = first[i[done]], first[j[done]]
                near = (np.bitwise_count(self.values[a] ^ self.values[b]) <= budget) & (a != b)
                yield a[near], b[near]
                i, j, d = i[~done], j[~done], d[~done]
            if not len(i):
                continue
            child = self.levels[level][2]
            i0, i1, j0, j1 = child[0][i], child[1][i], child[0][j], child[1][j]
            cross = d < budget
            other = cross & (i != j)  # a node with itself: its two children meet once
            out = [
                (a[ok], b[ok], e[ok]) for a, b, e, ok in (
                    (i0, j0, d, (i0 >= 0) & (j0 >= 0)), (i1, j1, d, (i1 >= 0) & (j1 >= 0)),
                    (i0, j1, d + 1, (i0 >= 0) & (j1 >= 0) & cross), (i1, j0, d + 1, (i1 >= 0) & (j0 >= 0) & other))]
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*out))))


def forest(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least position reachable from each of n, over links that come in chunks."""
    root = np.arange(n)
    for a, b in chunks:
        while len(a):
            a, b = root[a], root[b]
            a, b = np.maximum(a, b), np.minimum(a, b)
            a, b = a[a != b], b[a != b]
            np.minimum.at(root, a, b)
            while (root[root] != root).any():
                root = root[root]
    return root


def _subtrees(fps: DataFrame, node_fps: int, count_bits: int = COUNT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """First values and depths of the subtrees, in order.

    Prefixes are counted by ``count_bits`` bits, then under those with too many
    values by as many more bits as keep the counts within ``2**count_bits``. Too
    many is over ``node_fps`` and over four ``2**count_bits``-ths of all, so at
    most a quarter of ``2**count_bits`` prefixes go on.
    """
    def prefix(bits: int):
        return F.shiftrightunsigned("_sh_fp", 64 - bits)

    nodes, heavy, depth, most = [], [0], 0, node_fps
    while heavy:
        to = min(64, depth + max(1, count_bits - (len(heavy) - 1).bit_length()))
        rows = fps
        if depth:  # at most 2**count_bits / 4 prefixes
            under = fps.sparkSession.createDataFrame([(h,) for h in heavy], "_sh_p long")
            rows = fps.join(F.broadcast(under), prefix(depth) == F.col("_sh_p"), "left_semi")
        counts = sorted((p & PATH[64].item(), n) for p, n in rows.groupBy(prefix(to)).count().collect())
        firsts, total = [p for p, _ in counts], [0, *accumulate(n for _, n in counts)]
        if not depth:
            most = max(node_fps, -(-4 * total[-1] >> count_bits))
        stack, heavy = [(h, depth) for h in heavy], []
        while stack:
            p, d = stack.pop()
            n = total[bisect_left(firsts, p + 1 << to - d)] - total[bisect_left(firsts, p << to - d)]
            if n and n <= most:
                nodes.append((p << 64 - d, d))
            elif n and d == to:
                heavy.append(p)
            elif n:
                stack += [(2 * p + 1, d + 1), (2 * p, d + 1)]
        depth = to
    nodes.sort()
    return np.array([p for p, _ in nodes], np.uint64), np.array([d for _, d in nodes], np.int64)


def trie_links(fps: DataFrame, max_bits: int = MAX_BITS, node_fps: int = NODE_FPS, count_bits: int = COUNT_BITS) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints ``_sh_fp``."""
    starts, depths = _subtrees(fps, node_fps, count_bits)
    n_nodes = len(starts)

    def near(node: int) -> np.ndarray:
        """Subtrees whose paths differ from this one's within the budget."""
        shared = PATH[np.minimum(depths, depths[node])]
        return np.flatnonzero(np.bitwise_count((starts ^ starts[node]) & shared) <= max_bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            fp = pick(batch, "_sh_fp").to_numpy()
            node = np.searchsorted(starts, fp.view(np.uint64), side="right") - 1
            for k in np.unique(node).tolist():
                if k not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[k] = near(k)
                mine, others = fp[node == k], known[k]
                task = np.minimum(others, k) * n_nodes + np.maximum(others, k)
                packed = squeeze(np.sort(mine.view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(task), pa.array([packed] * len(task), pa.binary())], names=["task", "fps"])

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        u, v = divmod(key[0].as_py(), n_nodes)
        values = np.sort(np.concatenate([unsqueeze(x) for x in group.column("fps").to_pylist()]))
        depth = int(min(depths[u], depths[v]))
        trie = Trie(values, depth)
        top = values[trie.first] & PATH[depth]
        i, j = np.searchsorted(top, starts[[u, v]] & PATH[depth])
        d = np.bitwise_count(np.array([top[i] ^ top[j]]))
        root = forest(len(values), trie.pairs(np.array([i], np.int32), np.array([j], np.int32), d.astype(np.int8), max_bits))
        linked = np.flatnonzero(root != np.arange(len(values)))
        return pa.table({"a": values[linked].view(np.int64), "b": values[root[linked]].view(np.int64)})

    return fps.mapInArrow(deal, "task long, fps binary").groupBy("task").applyInArrow(join, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, node_fps: int = NODE_FPS) -> DataFrame:
    """One row per document: ``_sh_rid`` (its place in ``docs``), ``_sh_id``,
    ``_sh_fp``, ``_sh_component`` (least id reachable) and ``_sh_kept`` (true for
    one document of each component: least id, then first in input order)."""
    rows = with_rid(docs.select(F.col(id_col).alias("_sh_id"), F.col(text_col).alias("_sh_text")), "_sh_rid")
    fps = materialise(fingerprints(rows, "_sh_text", words), "simhash-fps")
    least = F.min(F.struct(F.col("_sh_id").isNull().alias("none"), F.col("_sh_id").alias("id"), F.col("_sh_rid").alias("rid")))
    own = materialise(fps.groupBy("_sh_fp").agg(least.alias("_sh_best")), "simhash-distinct")
    roots = components(trie_links(own.select("_sh_fp"), max_bits, node_fps))
    grouped = own.join(roots.toDF("_sh_fp", "_sh_root"), "_sh_fp", "left").withColumn("_sh_root", F.coalesce("_sh_root", "_sh_fp"))
    grouped = materialise(grouped, "simhash-roots")
    best = grouped.groupBy("_sh_root").agg(F.min("_sh_best").alias("_sh_first"))
    of_fp = grouped.join(best, "_sh_root").select("_sh_fp", "_sh_first")
    return fps.join(of_fp, "_sh_fp").select(
        "_sh_rid", "_sh_id", "_sh_fp", F.col("_sh_first.id").alias("_sh_component"), (F.col("_sh_first.rid") == F.col("_sh_rid")).alias("_sh_kept"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    return simhash_groups(docs).select(
        F.col("_sh_id").alias("doc_id"), F.lower(F.lpad(F.hex("_sh_fp"), 16, "0")).alias("fingerprint"), F.col("_sh_component").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component."""
    kept = simhash_groups(docs).where("_sh_kept").select("_sh_rid")
    return with_rid(docs, "_sh_rid").join(kept, "_sh_rid", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
