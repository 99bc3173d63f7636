"""Runs of repeated word sequences, by string synchronising sets.

A run is a stretch of words with a smallest period q that repeats at least
``LEAST_TIMES`` times and that no neighbouring word extends. All texts of a
batch are one sequence of word numbers (exact, from a dictionary of the
batch's words) with a different separator after each text, so no run leaves
its text. Runs are found by their period:

1. Small periods, under ``DIRECT``, by comparing the sequence with itself
   shifted. They also are the highly periodic regions of the larger scales.
2. Periods from t on and under 2t, for every t = ``DIRECT``, 2 ``DIRECT``, ...:
   a window of t words is named by its hash. A place belongs to the
   synchronising set if, of the t + 1 windows that start from it on, the least
   name is the first's or the last's. Windows that lie in a known run of a
   period of at most t / 4 (highly periodic ones) take no part; their periods
   are found already. Membership depends on 2t words only, so a run of period
   q has members q apart whose 2t words are equal, and no nearer such pair:
   every pair of neighbouring equal contexts t to 2t - 1 apart proposes its
   distance as a period.
3. A proposal is extended both ways by comparing hashes of ranges, halving the
   step. Then the words themselves are compared, so that a colliding hash adds
   no run.

Where one stretch has several periods, the smallest is its period.

Documents are independent: one narrow step, no shuffle. A worker holds one
batch of at most ``SLICE_BYTES`` of text (or one longer text), some arrays of
a number per word and nothing that grows with the number of scales.

Defined results: a null or empty text has no run, no words and an empty rest;
repeated rows are rows of their own; ids are carried, null ones too; an empty
table gives no rows; other columns are carried by name, and a name that is
taken already is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import SLICE_BYTES, mix, pick, range_hashes, ranges, slices, small_batches, utf8

#: Periods below this are found by direct comparison; the scale of the first synchronising set.
DIRECT = 4
#: How often a period is repeated at least, and words of a run at least.
LEAST_TIMES, LEAST_WORDS = 4, 6

_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of the texts, in order, and how many each text has."""
    word = _WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True
    before = np.concatenate([[False], word[:-1]]) if len(raw) else word
    starts = np.flatnonzero(word & (~before | first[:-1]))
    # bytes of words follow one another once the rest is left out
    upto = np.concatenate([[0], np.cumsum(word)])
    ends = np.append(upto[starts], upto[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[word]))])
    return words, np.diff(np.searchsorted(starts, off))


def sequence(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts with a number of its own after each text, and each text's start in it."""
    ends = np.cumsum(counts)
    out = np.insert(ids.astype(np.int64), ends, int(ids.max(initial=0)) + 1 + np.arange(len(counts)))
    return out, ends - counts + np.arange(len(counts))


def word_sums(seq: np.ndarray) -> np.ndarray:
    """Prefix polynomial of the sequence: sums of mixed word numbers times powers of a base."""
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, len(seq) - 1), base)]))
    sums = np.zeros(len(seq) + 1, np.uint64)
    np.cumsum(mix(seq.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * powers[:len(seq)], out=sums[1:])
    return sums


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        names, have = np.minimum(names[:-have], names[have:]), 2 * have
    return np.minimum(names[:len(names) - (width - have)], names[width - have:]) if have < width else names


def _small(seq: np.ndarray, q: int, times: int) -> np.ndarray:
    """Rows (start, end, q) of the stretches of period q, of ``times`` periods at least."""
    same = np.concatenate([[False], seq[q:] == seq[:-q], [False]]).astype(np.int8) if len(seq) > q else np.zeros(2, np.int8)
    edge = np.diff(same)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
    keep = end - start >= times * q
    return np.stack([start, end, np.full(len(start), q)], axis=1)[keep]


def doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Names of all windows of 2t words from those of t. The two halves are mixed
    in turn: sums of powers would be alike for long words of Thue-Morse kind."""
    return mix(mix(names[:-t]) * np.uint64(0xC2B2AE3D27D4EB4F) + names[t:]) if len(names) > t else names[:0]


def _context_pairs(name: np.ndarray, context: np.ndarray, t: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of neighbouring members of the synchronising set with equal contexts."""
    n = len(context)
    name = np.where(periodic[:n + t], _NONE, name[:n + t])
    least = _least(name, t + 1)[:n]
    member = np.flatnonzero(((least == name[:n]) | (least == name[t:n + t])) & (least != _NONE))
    own = context[member]
    order = np.argsort(own, kind="stable")  # stable: places in order
    a, b = member[order[:-1]], member[order[1:]]
    near = (own[order[:-1]] == own[order[1:]]) & (b - a >= t) & (b - a < 2 * t)
    return a[near], (b - a)[near]


def _extend(seq: np.ndarray, sums: np.ndarray, at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretch of period q around each place: how far the words
    from ``at`` on equal those q later, and those before it likewise."""
    n = len(seq)
    more, less = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        x = at + more
        ok = np.flatnonzero(x + q + step <= n)
        ok = ok[range_hashes(sums, x[ok], x[ok] + step) == range_hashes(sums, x[ok] + q[ok], x[ok] + q[ok] + step)]
        more[ok] += step
        x = at - less
        ok = np.flatnonzero(x - step >= 0)
        ok = ok[range_hashes(sums, x[ok] - step, x[ok]) == range_hashes(sums, x[ok] - step + q[ok], x[ok] + q[ok])]
        less[ok] += step
        step >>= 1
    return at - less, at + more + q


def _exact(seq: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the words of each stretch, but the last q, equal those q later."""
    out = np.zeros(len(start), bool)
    at = 0
    while at < len(start):  # so many stretches at once as have a batch's words
        size = np.cumsum(end[at:] - start[at:])
        to = at + max(1, int(np.searchsorted(size, SLICE_BYTES, side="right")))
        length = end[at:to] - start[at:to] - q[at:to]
        x = ranges(start[at:to], length)
        differ = seq[x] != seq[x + np.repeat(q[at:to], length)]
        out[at:to] = np.bincount(np.repeat(np.arange(to - at), length), differ, to - at) == 0
        at = to
    return out


def _walk(seq: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The stretch of period q around one place, word by word (where a hash collided)."""
    start, end = at, at
    while start > 0 and seq[start - 1] == seq[start - 1 + q]:
        start -= 1
    while end + q < len(seq) and seq[end] == seq[end + q]:
        end += 1
    return start, end + q


def find_runs(seq: np.ndarray, longest: int, times: int = LEAST_TIMES, hashes=word_sums) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and then period; ``longest``
    is the most words of a text. ``times`` is 4 at least."""
    if times < 4:
        raise ValueError(f"runs of {times} periods; the context pairs are complete from 4 on")
    found = _smallest(np.concatenate([_small(seq, q, times) for q in range(1, DIRECT)]))
    sums, name, t = hashes(seq), mix(seq.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1
    while t < DIRECT:
        name, t = doubled(name, t), 2 * t
    while times * t <= longest:
        context = doubled(name, t)
        calm = found[(found[:, 2] * 4 <= t) & (found[:, 1] - found[:, 0] >= t)]
        edge = np.zeros(len(seq) + 1, np.int64)
        np.add.at(edge, calm[:, 0], 1)
        np.add.at(edge, calm[:, 1] - t + 1, -1)
        at, q = _context_pairs(name, context, t, np.cumsum(edge[:-1]) > 0)
        start, end = _extend(seq, sums, at, q)
        keep = end - start >= times * q
        rows, first = np.unique(np.stack([start, end, q], axis=1)[keep], axis=0, return_index=True)
        true = _exact(seq, rows[:, 0], rows[:, 1], rows[:, 2])
        for k in np.flatnonzero(~true).tolist():
            p = int(rows[k, 2])
            for place in np.unique(at[(start == rows[k, 0]) & (end == rows[k, 1]) & (q == p)]).tolist():
                a, b = _walk(seq, place, p)
                if b - a >= times * p:
                    rows, true = np.concatenate([rows, [[a, b, p]]]), np.append(true, True)
        found = _smallest(np.concatenate([found, rows[true]]))
        name, t = context, 2 * t
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows with one start and end, that of the least period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows.reshape(0, 3)


def _joined(words: pa.BinaryArray, kept: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """Each text's kept words, joined by one space."""
    off = np.frombuffer(words.buffers()[1], np.int32)[:len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) else np.zeros(0, np.uint8)
    length = np.diff(off)[kept]
    text = np.repeat(np.arange(len(counts)), counts)[kept]
    lead = np.concatenate([[False], text[1:] == text[:-1]])[:len(text)].astype(np.int64)  # a space before all but a text's first
    to = np.cumsum(length + lead)
    out = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
    out[ranges(to - length, length)] = raw[ranges(off[:-1][kept], length)]
    size = np.bincount(text, length + lead, len(counts)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())


def periodic_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "_pr_runs", rest_col: str = "_pr_rest", words_col: str = "_pr_words", times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` plus its runs (array of start, length, period in words, by start and
    then period), the text without their repetitions (binary: its words but those
    of a run after its first period, joined by one space), and its number of words."""
    taken = {runs_col, rest_col, words_col} & set(docs.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words, counts = words_of(*utf8(pick(batch, text_col)))
            seq, head = sequence(np.asarray(words.dictionary_encode().indices), counts)
            found = find_runs(seq, int(counts.max(initial=0)), times)
            found = found[found[:, 1] - found[:, 0] >= least]
            edge = np.zeros(len(seq) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 1], -1)
            kept = np.delete(np.cumsum(edge[:-1]) == 0, head + counts)  # without the separators
            text = np.searchsorted(head, found[:, 0], side="right") - 1
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            struct = pa.StructArray.from_arrays([pa.array(found[:, 0] - head[text]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*(pick(batch, c) for c in names), pa.ListArray.from_arrays(pa.array(ends), struct), _joined(words, np.flatnonzero(kept), counts), pa.array(counts)],
                names=[*names, runs_col, rest_col, words_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(runs_col, T.ArrayType(RUN, False)), T.StructField(rest_col, T.BinaryType()), T.StructField(words_col, T.LongType())])
    return docs.mapInArrow(run, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, where the contract asks for it with a period from one of its words
    on: by the id's hash h, if h % 10 = 0 (a null id: never)."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def bend(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1))
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when((h % 10 == 0) & (F.size(words) > 0), F.transform(F.array(words), bend)[0]).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_runs, the strongest run (start, length, period,
    exponent_milli), runs_sha256, collapsed_sha256."""
    out = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    run = F.col("_pr_runs")
    # length / period as exact fractions; runs come by start and period, so an equal later one does not replace
    best = F.reduce(run, F.get(run, F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.array_join(F.transform(run, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return out.withColumn("_pr_best", best).select(
        "doc_id", F.size(run).cast("long").alias("n_runs"), F.col("_pr_best.start").alias("start"), F.col("_pr_best.length").alias("length"), F.col("_pr_best.period").alias("period"),
        F.expr("(1000 * _pr_best.length) div _pr_best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2("_pr_rest", 256).alias("collapsed_sha256"))
