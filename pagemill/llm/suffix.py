"""Repeated-passage removal by merging shards of sampled suffixes.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts
anywhere else. Sampling makes this a merge of small, independent parts:

1. Every window of ``LENGTH`` bytes names one anchor, the least hash among its
   ``GRAM``-byte strings (the leftmost such). Equal windows name equal anchors
   at equal distances, so only occurrences of one anchor need be compared.
   Anchors whose string occurs once are dropped. Of occurrences whose whole
   neighbourhood (all windows that name them) is equal, one stands for all,
   with how many there are.
2. A shard (a slice of what one task has scanned) is a sampled Burrows-Wheeler
   transform: its anchors' suffixes in sorted order, each with the bytes before
   it, its rank and how many bytes it shares with the one of the rank before.
   The shards of an anchor are merged by refining their interleave: first each
   shard's suffixes follow those of the shard before. A pass splits the blocks
   that agree on the first h bytes by the next eight. Only the heads of a
   shard's stretches that share those bytes, as its common prefixes tell, are
   looked at; what follows them keeps its rank behind them. Passes end when a
   block holds one stretch. Where a block splits, the common prefix is known.
3. From the merged order one goes backwards as in a Burrows-Wheeler transform:
   step d reorders the suffixes, stably, by the byte d places before their
   anchor. Suffixes that share those d bytes and lie in one interval whose
   common prefix has ``LENGTH`` - d bytes hold a repeated window, which starts
   d bytes before the anchor.
4. Found windows are carried back to all occurrences and to their documents.

No suffix is compared with another but through these orders. An anchor with
very many different neighbourhoods (``SPLIT`` and over) is not merged in one
task: its windows are dealt out by their content instead.

What belongs to the documents of one scan partition is written to a folder of
its own in the shared folder and read by the task that scans it, so texts are
not shuffled.

Defined results: a null text is empty; texts shorter than ``LENGTH`` bytes stay
whole; repeated rows are documents of their own and remove each other; a null
id is carried through; an empty table gives no rows; internal names begin
with ``_sx_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import beside, materialise, own_rows, pick, prefix_hashes, range_hashes, ranges, slices, utf8, with_rid

#: Bytes of a repeated string, and of the strings that serve as anchors.
LENGTH, GRAM = 200, 32
#: Different neighbourhoods of one anchor that are merged in one task.
SPLIT = 100_000
#: Suffixes of a task, about, and those that it merges at once (but for an anchor with more).
TASK_ROWS, MERGE_ROWS = 200_000, 10_000
#: Text bytes whose anchors are chosen at once, and whose suffixes are a shard.
SLICE_BYTES = 1 << 18
#: Positions handled at once when anchors are chosen.
CHUNK = 1 << 15


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    n = len(keys) - width + 1
    out = np.empty(max(0, n), keys.dtype)
    for at in range(0, n, CHUNK):
        part, have = keys[at:min(n, at + CHUNK) + width - 1], 1
        while 2 * have <= width:
            part, have = np.minimum(part[:-have], part[have:]), 2 * have
        out[at:at + CHUNK] = np.minimum(part[:len(part) - (width - have)], part[width - have:]) if have < width else part
    return out


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The anchors of all windows that lie within one text each: text, start of
    the first window, windows, bytes before the anchor in the first window, the
    anchor's hash and the neighbourhood's."""
    n = len(raw) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0 or not (np.diff(off) >= length).any():
        return {"row": empty, "start": empty, "wins": empty, "left": empty, "ah": empty, "nh": empty}
    sums = prefix_hashes(raw)
    place = np.arange(len(raw) - gram + 1)
    hashes = range_hashes(sums, place, place + gram)
    bits = np.uint64(len(raw).bit_length())
    least = sliding_least(hashes >> bits << bits | place.astype(np.uint64), length - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)[:n]
    whole = np.flatnonzero(np.diff(off) >= length)
    window = ranges(off[whole], np.diff(off)[whole] - length + 1)
    named = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (window[1:] != window[:-1] + 1)]))
    start, wins, at = window[first], np.diff(np.append(first, len(window))), named[first]
    row = np.searchsorted(off, start, side="right") - 1
    nh = range_hashes(sums, start, start + wins - 1 + length) + (at - start).astype(np.uint64)
    return {"row": row, "start": start - off[row], "wins": wins, "left": at - start, "ah": hashes[at].view(np.int64), "nh": nh.view(np.int64)}


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rids, offsets in their texts, bytes, row offsets); a very long text comes
    in pieces that overlap by ``length`` - 1 bytes, so that each window is in one."""
    for batch in slices(batches, "_sx_text", SLICE_BYTES):
        rid = pick(batch, "_sx_rid").to_numpy()
        raw, off = utf8(pick(batch, "_sx_text"))
        if len(raw) <= 2 * SLICE_BYTES:
            yield rid, np.zeros(len(rid), np.int64), raw, off
            continue
        for at in range(0, len(raw), SLICE_BYTES):  # such a batch is one text
            part = raw[at:at + SLICE_BYTES + length - 1]
            yield rid, np.array([at]), part, np.array([0, len(part)])


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of two matrices share."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def interleave(block: np.ndarray, shard: np.ndarray, lcp: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes shared with the one before) of suffixes that come by block, shard and
    rank; ``lcp`` is that with the rank before in the shard, ``words`` their bytes, eight at a time."""
    n, length = len(block), 8 * words.shape[1]
    order, common = np.arange(n), np.zeros(n, np.int64)
    common[1:][block[1:] == block[:-1]] = length
    for w in range(words.shape[1]):
        same = np.concatenate([[False], block[1:] == block[:-1], [False]])
        open_at = np.flatnonzero(same[:-1] | same[1:])  # places in blocks of two or more
        if not len(open_at):
            break
        own, of = order[open_at], block[open_at]
        # a stretch of one shard that shares this word goes where its head goes
        follows = (of[1:] == of[:-1]) & (own[1:] == own[:-1] + 1) & (shard[own[1:]] == shard[own[:-1]]) & (lcp[own[1:]] >= 8 * (w + 1))
        head = np.flatnonzero(np.concatenate([[True], ~follows]))
        size = np.diff(np.append(head, len(own)))
        word = words[own[head], w]
        step = np.lexsort((word, of[head]))  # stable: equal words keep the order of the shards
        order[open_at] = own[ranges(head[step], size[step])]
        word, of, at = word[step], of[head][step], np.cumsum(size[step]) - size[step]
        split = np.flatnonzero((word[1:] != word[:-1]) & (of[1:] == of[:-1]))
        differ = word[1:][split] ^ word[:-1][split]
        equal = np.zeros(len(split), np.int64)
        for k in range(1, 8):
            equal += differ >> np.uint64(64 - 8 * k) == 0
        place = open_at[at[split + 1]]
        common[place] = 8 * w + equal
        new = np.zeros(n, np.int64)
        new[place] = 1
        block = block + np.cumsum(new)
    return order, common


def merge(ah: np.ndarray, shard: np.ndarray, lcp: np.ndarray, text: np.ndarray, left: np.ndarray, wins: np.ndarray, several: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First and last d of the repeated windows of each neighbourhood (-1: none).

    They come by anchor, shard and rank. ``text`` holds, for each, ``length``
    bytes from its anchor on and before them, reversed, the bytes before the
    anchor (zeros beyond the neighbourhood); windows are named by d, the bytes
    before their anchor; ``several`` marks neighbourhoods that occur more than once.
    """
    n = len(ah)
    before = text[:, length:]
    least = left - wins + 1  # d of a neighbourhood's last window; left is that of its first
    low, high = np.where(several, least, -1), np.where(several, left, -1)
    block = np.cumsum(np.concatenate([[0], ah[1:] != ah[:-1]])) if n else np.zeros(0, np.int64)
    order, common = interleave(block, shard, lcp, np.ascontiguousarray(text[:, :length]).view(">u8").astype(np.uint64))

    # backwards over the bytes before the anchors
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    now = order  # live ones, sorted by (anchor, the d bytes before it, rank)
    kind = np.cumsum(np.concatenate([[0], ah[order][1:] != ah[order][:-1]])) if n else np.zeros(0, np.int64)
    for d in range(int(left.max(initial=-1)) + 1):
        interval = np.cumsum(common < length - d)
        here = least[now] <= d
        own, group, span = now[here], kind[here], interval[rank[now[here]]]
        pair = (group[1:] == group[:-1]) & (span[1:] == span[:-1])
        found = own[np.concatenate([[False], pair]) | np.concatenate([pair, [False]])] if len(own) else own
        low[found] = np.where(low[found] < 0, d, np.minimum(low[found], d))
        high[found] = np.maximum(high[found], d)
        go_on = left[now] > d
        now, kind = now[go_on], kind[go_on]
        if not len(now):
            break
        byte = before[now, d]
        step = np.lexsort((byte, kind))
        now, byte, kind = now[step], byte[step], kind[step]
        starts = np.concatenate([[True], (kind[1:] != kind[:-1]) | (byte[1:] != byte[:-1])])
        kind = np.cumsum(starts)
        alone = starts & np.concatenate([starts[1:], [True]])  # shares its bytes with no other
        now, kind = now[~alone], kind[~alone]
    return low, high


def repeated(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """(_sx_rid, _sx_spans): of each row of ``docs``, numbered by ``with_rid``, the
    byte ranges that repeated strings cover. Rows without any are left out."""
    rows = with_rid(docs.select(F.col(text_col).alias("_sx_text")), "_sx_rid")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, base, raw, off in _pieces(batches, length):
            a = anchors(raw, off, length, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["ah"]), pa.array(a["nh"]), pa.array(rid[a["row"]]), pa.array(a["start"] + base[a["row"]]), pa.array(a["left"].astype(np.int16)), pa.array(a["wins"].astype(np.int16))],
                names=["ah", "nh", "_sx_rid", "start", "left", "wins"])

    found = materialise(rows.mapInArrow(find, "ah long, nh long, _sx_rid long, start long, left smallint, wins smallint"), "anchors")
    # written first, so that both sides of the join are exchanged for it and a hot anchor can be split
    often = materialise(found.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ah"), "anchors-often")
    shared = materialise(found.join(often, "ah"), "anchors-shared")

    # one occurrence stands for all with an equal neighbourhood
    stands = F.min(F.struct("_sx_rid", "start", "left", "wins")).alias("o")
    kinds = shared.groupBy("ah", "nh").agg(F.count(F.lit(1)).alias("n"), stands)
    kinds = materialise(kinds.select("ah", "nh", (F.col("n") > 1).alias("several"), "o.*"), "neighbourhoods")
    wide = kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("ah")
    wide_n = wide.count()
    total = kinds.count()
    by_scan = beside(kinds, "_sx_rid", "neighbourhoods-by-scan")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's neighbourhoods in suffix order, each with its bytes."""
        mine = None
        for batch in slices(batches, "_sx_text", SLICE_BYTES):
            rid = pick(batch, "_sx_rid").to_numpy()
            if mine is None:
                mine = own_rows(by_scan, int(rid[0] >> 33))
                if mine is None:
                    return
                mine = mine.sort_by("_sx_rid")
                owner = mine.column("_sx_rid").to_numpy()
            raw, off = utf8(pick(batch, "_sx_text"))
            a, b = np.searchsorted(owner, rid[0]), np.searchsorted(owner, rid[-1], side="right")
            if a == b:
                continue
            part = mine.slice(a, b - a)
            start, left, wins = (part.column(c).to_numpy().astype(np.int64) for c in ("start", "left", "wins"))
            start = start + off[np.searchsorted(rid, owner[a:b])]
            size = wins - 1 + length
            ends = np.concatenate([[0], np.cumsum(size)])
            bytes_ = raw[ranges(start, size)]
            ah, right = part.column("ah").to_numpy(), _beside_anchor(bytes_, ends, left, length)[0]
            order = np.lexsort((*np.ascontiguousarray(right).view(">u8").T[::-1], ah))
            ah, right = ah[order], right[order]
            lcp = np.zeros(len(ah), np.int64)
            lcp[1:] = np.where(ah[1:] == ah[:-1], shared_bytes(right[1:], right[:-1]), 0)
            text = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(bytes_)]).cast(pa.binary())
            part = part.select(["ah", "nh", "several", "left", "wins"]).append_column("text", text).take(pa.array(order))
            part = part.append_column("shard", pa.array(np.full(len(ah), rid[0]))).append_column("rank", pa.array(np.arange(len(ah), dtype=np.int32))).append_column("lcp", pa.array(lcp.astype(np.int16)))
            yield from part.combine_chunks().to_batches()

    shards = rows.mapInArrow(shard, "ah long, nh long, several boolean, left smallint, wins smallint, text binary, shard long, rank int, lcp smallint")
    if wide_n:
        shards = materialise(shards, "shards")
        merged = _merged(shards.join(wide, "ah", "left_anti"), total, length)
        merged = merged.union(_dealt(shards.join(wide, "ah", "left_semi"), length))
    else:
        merged = _merged(shards, total, length)
    cover = shared.join(merged, ["ah", "nh"]).select(
        "_sx_rid", (F.col("start") + F.col("left") - F.col("high")).alias("a"), (F.col("start") + F.col("left") - F.col("low") + length).alias("b"))
    return cover.groupBy("_sx_rid").agg(F.collect_list(F.struct("a", "b")).alias("_sx_spans"))


def _beside_anchor(raw: np.ndarray, off: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from each anchor on, and those before it, backwards (zeros beyond the text's ends)."""
    n = len(left)
    after, before = np.zeros((n, length), np.uint8), np.zeros((n, length), np.uint8)
    for a in range(0, n, MERGE_ROWS):
        part, row = slice(a, min(n, a + MERGE_ROWS)), np.arange(min(n, a + MERGE_ROWS) - a)
        at, none = off[:-1][part] + left[part], np.zeros(len(row))
        size = np.minimum(off[1:][part] - at, length)
        after[part][np.repeat(row, size), ranges(none, size)] = raw[ranges(at, size)]
        back = ranges(none, left[part])
        before[part][np.repeat(row, left[part]), back] = raw[np.repeat(at - 1, left[part]) - back]
    return after, before


def _merged(shards: DataFrame, total: int, length: int) -> DataFrame:
    """Repeated windows (ah, nh, low, high) by merging the shards of each anchor."""
    def some(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ah, nh, shard = (rows.column(c).to_numpy() for c in ("ah", "nh", "shard"))
        left, wins, lcp = (rows.column(c).to_numpy().astype(np.int64) for c in ("left", "wins", "lcp"))
        text = np.concatenate(_beside_anchor(*utf8(rows.column("text")), left, length), axis=1)
        low, high = merge(ah, shard, lcp, text, left, wins, rows.column("several").to_numpy(), length)
        hit = np.flatnonzero(low >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(ah[hit]), pa.array(nh[hit]), pa.array(low[hit]), pa.array(high[hit])], names=["ah", "nh", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # rows come by anchor; whole anchors are merged
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= MERGE_ROWS:
                rows = pa.Table.from_batches(held)
                ah = rows.column("ah").to_numpy()
                cut = int(np.searchsorted(ah, ah[-1]))
                if cut:
                    yield from some(rows.slice(0, cut))
                held, n = rows.slice(cut).combine_chunks().to_batches(), len(ah) - cut
        if n:
            yield from some(pa.Table.from_batches(held))

    return (shards.repartition(max(8, total // TASK_ROWS), "ah").sortWithinPartitions("ah", "shard", "rank")
            .mapInArrow(run, "ah long, nh long, low long, high long"))


def _dealt(shards: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many neighbourhoods for one task: each of
    their windows is a row, counted by its content."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, off = utf8(pick(batch, "text"))
            left, wins = (pick(batch, c).to_numpy().astype(np.int64) for c in ("left", "wins"))
            of = np.repeat(np.arange(len(wins)), wins)
            step = ranges(np.zeros(len(wins)), wins)
            start = off[of] + step
            key = [hashlib.blake2b(raw[s:s + length].tobytes(), digest_size=16).digest() for s in start.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*(pick(batch, c).take(pa.array(of)) for c in ("ah", "nh", "several")), pa.array(left[of] - step), pa.array(key, pa.binary())], names=["ah", "nh", "several", "d", "key"])

    one = materialise(shards.mapInArrow(windows, "ah long, nh long, several boolean, d long, key binary"), "windows")
    many = one.groupBy("ah", "key").agg(F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("n")).where("n > 1").select("ah", "key")
    return one.join(many, ["ah", "key"]).groupBy("ah", "nh").agg(F.min("d").alias("low"), F.max("d").alias("high"))


def union_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by byte ranges."""
    out: list[list[int]] = []
    for s in sorted(spans or (), key=lambda s: s["a"]):
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text_col: str = "text", kept_col: str = "_sx_kept", runs_col: str = "_sx_runs", length: int = LENGTH, gram: int = GRAM, split: int = SPLIT) -> DataFrame:
    """``docs`` plus the bytes that stay (binary) and the removed runs (array of structs a, b)."""
    by_scan = beside(repeated(docs, text_col, length, gram, split), "_sx_rid", "spans-by-scan")
    rows = with_rid(docs, "_sx_rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for batch in slices(batches, text_col):
            rid = pick(batch, "_sx_rid").to_pylist()
            if mine is None:
                own = own_rows(by_scan, rid[0] >> 33)
                mine = dict(zip(own.column("_sx_rid").to_pylist(), own.column("_sx_spans").to_pylist())) if own else {}
            kept, runs = [], []
            for r, text in zip(rid, pick(batch, text_col).cast(pa.binary()).to_pylist()):
                text, gone = text or b"", union_spans(mine.get(r))
                edges = [0, *(x for run in gone for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                runs.append([{"a": a, "b": b} for a, b in gone])
            names = [c for c in batch.schema.names if c != "_sx_rid"]
            yield pa.RecordBatch.from_arrays(
                [*(pick(batch, c) for c in names), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=[*names, kept_col, runs_col])

    run = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    return rows.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField(kept_col, T.BinaryType()), T.StructField(runs_col, run)]))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs.select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", size.alias("n_bytes"), (size - F.octet_length("_sx_kept")).alias("n_removed"), F.size("_sx_runs").cast("long").alias("n_spans"), F.sha2("_sx_kept", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their repeated passages. A character
    that a removed run has cut through is left out whole; ``n_chars`` is counted anew."""
    out, columns = remove_repeats(docs), docs.columns

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b.decode("utf-8", "ignore") for b in pick(batch, "_sx_kept").to_pylist()]
            was = pick(batch, "text").is_null().to_pylist()
            value = {"text": pa.array([None if n else k for k, n in zip(kept, was)], pa.string())}
            if "n_chars" in batch.schema.names:
                value["n_chars"] = pa.array([None if n else len(k) for k, n in zip(kept, was)], pa.int64())
            yield pa.RecordBatch.from_arrays([value[c] if c in value else pick(batch, c) for c in columns], names=columns)

    return out.mapInArrow(text, docs.schema)
