"""Interpolated modified Kneser-Ney model of any order over sorted arrays that workers map.

Counting runs in Spark. Every task counts what it has read and sends sorted,
compressed arrays, one for each range of keys, so frequent words are combined
before the shuffle. A range is merged by one task, which writes plain files in
the shared folder:

* ``hash-k``, ``count-k``: the 64-bit hashes of all words, sorted over all
  ranges k, and their counts; a word's place is its number;
* ``gram2-b``, ``times2-b``: the bigrams as (number of the first word, number of
  the second), sorted over all ranges b, and their counts (255 and over are
  kept apart in ``times2-b-over``); a bigram's place is its number;
* ``gram3-b``, ``times3-b`` and so on up to the order: the n-grams as (number of
  the n-gram without its last word, number of the last word), in the same way;
* ``left1-k``, ``back1-k``, ``left2-b`` and so on below the order: in how many
  contexts each n-gram occurs, and its summed discounts as a context; and below
  the order by two ``sum1-k`` and so on, what its counts as a context add up to.

An n-gram at the head of a text has the end token before it and nothing before
that, so below the order its own count stands in for its contexts, and a text's
n-th word is read with at most n words before it, the end token included.

Ranges of n-grams have equal shares of the counted words; a frequent context
is cut by its last words. Workers map the files and look up sorted, distinct
keys of a batch at a time, so a worker's own memory does not grow with the
model. A key has 64 bits, which is checked; counts have 64 bits.

The shared folder must be mounted on all machines, since files are mapped.

Defined results: a null text is empty and consists of the end token; a row with
a null id is scored but not learned from, and its ``held_out`` is null; with
nothing to learn from every token has probability one; repeated rows count as
often as they occur; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import byte_hash, local_path, materialise, mix, mod_of_id, pick, segment_sums, shared_path, slices, squeeze, unsqueeze, utf8

#: Text bytes for each range of words and of n-grams.
WORD_BYTES, PAIR_BYTES = 96 << 20, 32 << 20
#: Keys a task gathers before it counts and sends them.
FLUSH_KEYS = 1 << 22
#: Points by which a range of words tells how its counts are spread.
POINTS = 64

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
#: The hash of the end token, which also stands before the first word.
END = np.uint64(0x5851F42D4C957F2D)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, in order, and how many each text has."""
    raw = _LOWER[raw]
    word = _WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off[:-1]] = True
    before = np.concatenate([[False], word[:-1]]) if len(raw) else word
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(raw) else word
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    upto = np.searchsorted(starts, off[1:])  # words before the end of each text
    return np.insert(byte_hash(raw, starts, ends), upto, END), np.diff(upto, prepend=0) + 1


def counted(keys: list[np.ndarray], times: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable") if times is not None else None
    every = every[order] if times is not None else np.sort(every)
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    if times is None:
        return every[starts], np.diff(np.append(starts, len(every)))
    return every[starts], np.add.reduceat(np.concatenate(times)[order], starts) if len(every) else np.zeros(0, np.int64)


def _parcels(keys: np.ndarray, times: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys as one row for each range; range r starts at edges[r]."""
    at = np.append(np.searchsorted(keys, edges), len(keys))
    for r in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[r], at[r + 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r], pa.int32()), pa.array([squeeze(keys[part])], pa.binary()), pa.array([squeeze(times[part].astype(np.uint64))], pa.binary())], names=["r", "keys", "times"])


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, np.ndarray, np.ndarray]:
    """The one range that a partition holds, with its distinct keys and counts."""
    r, keys, times, held = None, [], [], 0
    for batch in batches:
        for own, k, t in zip(*(pick(batch, c).to_pylist() for c in ("r", "keys", "times"))):
            r = own
            keys.append(unsqueeze(k))
            times.append(unsqueeze(t).astype(np.int64))
            held += len(keys[-1])
            if held > 2 * FLUSH_KEYS and len(keys) > 8:
                k, t = counted(keys, times)
                keys, times, held = [k], [t], 0
    return r, *counted(keys, times)


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Writes one array; a task that runs again replaces the file whole."""
    mark = f"{folder}/{name}.{os.getpid()}-{np.random.default_rng().integers(1 << 60)}"
    values.tofile(mark)
    os.replace(mark, f"{folder}/{name}")


def _open(folder: str, name: str, kind: str) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many keys have count 1 to 4."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in n)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(k, max(0.05, d)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


def _save_counts(folder: str, name: str, values: np.ndarray) -> None:
    """One byte for each count, and those of 255 and over apart."""
    large = np.flatnonzero(values >= 255)
    _save(folder, f"{name}-over", np.stack([large, values[large]], axis=1).astype("<u8"))
    _save(folder, name, np.minimum(values, 255).astype("u1"))


def _points(times: np.ndarray) -> tuple[list[int], list[float]]:
    """Where a range's counts reach equal shares: places, and parts of the count there."""
    upto = np.cumsum(times)
    goal = upto[-1] * np.arange(POINTS) // POINTS
    at = np.searchsorted(upto, goal, side="right")
    return at.tolist(), ((goal - (upto[at] - times[at])) / times[at]).tolist()


@dataclass
class Level:
    """All n-grams of one length; those of length one are the words."""

    edges: np.ndarray  # first key of each range
    base: np.ndarray  # number of each range's first n-gram, and of all
    heads: tuple[int, int] = (0, 0)  # numbers of those that begin with the end token
    off: np.ndarray = field(default_factory=lambda: np.zeros(4))  # discounts


@dataclass
class Model:
    folder: str
    order: int
    n_tokens: int
    levels: list[Level]  # by length, from one
    back: float = 0.0  # summed discounts of the words

    @property
    def n_words(self) -> int:
        return int(self.levels[0].base[-1])

    @property
    def shift(self) -> np.uint64:
        """Bits of a word's number in a key."""
        return np.uint64(self.n_words.bit_length())


class Reader:
    """One task's view of the files."""

    def __init__(self, model: Model):
        self.model = model
        self.tables: dict[str, np.ndarray] = {}

    def table(self, name: str, kind: str) -> np.ndarray:
        if name not in self.tables:
            self.tables[name] = _open(self.model.folder, name, kind)
        return self.tables[name]

    def find(self, n: int, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted distinct keys of length n, -1 where unknown."""
        level, out = self.model.levels[n - 1], np.full(len(keys), -1, np.int64)
        at = np.append(np.searchsorted(keys, level.edges), len(keys))
        at[0] = 0
        for r in np.flatnonzero(np.diff(at)).tolist():
            own, table = keys[at[r]:at[r + 1]], self.table(f"hash-{r}" if n == 1 else f"gram{n}-{r}", "<u8")
            if len(table):
                place = np.minimum(np.searchsorted(table, own), len(table) - 1)
                out[at[r]:at[r + 1]] = np.where(table[place] == own, place + level.base[r], -1)
        return out

    def of(self, n: int, name: str, kind: str, numbers: np.ndarray) -> np.ndarray:
        """Values of n-grams by sorted numbers; of kind "u1" are counts as ``_save_counts`` writes them."""
        base = self.model.levels[n - 1].base
        out = np.zeros(len(numbers), {"<f4": np.float64, "<u8": np.uint64, "u1": np.int64}[kind])
        at = np.searchsorted(numbers, base)
        for r in np.flatnonzero(np.diff(at)).tolist():
            place = numbers[at[r]:at[r + 1]] - base[r]
            values = self.table(f"{name}-{r}", kind)[place]
            if kind == "u1":
                values = values.astype(np.int64)
                large = np.flatnonzero(values == 255)
                if len(large):
                    over = self.table(f"{name}-{r}-over", "<u8").reshape(-1, 2)
                    values[large] = over[np.searchsorted(over[:, 0], place[large]), 1]
            out[at[r]:at[r + 1]] = values
        return out

    def of_any(self, n: int, name: str, kind: str, numbers: np.ndarray) -> np.ndarray:
        """The same as floats, by numbers in any order; 0 for those below 0."""
        out, known = np.zeros(len(numbers)), numbers >= 0
        distinct, place = np.unique(numbers[known], return_inverse=True)
        out[known] = self.of(n, name, kind, distinct)[place]
        return out

    def key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) << self.model.shift | word.astype(np.uint64)

    def parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the context and of the last word."""
        return (keys >> self.model.shift).astype(np.int64), (keys & ((np.uint64(1) << self.model.shift) - np.uint64(1))).astype(np.int64)

    def tails(self, n: int, numbers: np.ndarray) -> np.ndarray:
        """Numbers of n-grams, given by sorted numbers, without their first word; -1 without one."""
        context, word = self.parts(self.of(n, f"gram{n}", "<u8", numbers))
        if n == 2:
            return word
        tail = self.tails(n - 1, context)
        keys, place = np.unique(self.key(tail, word), return_inverse=True)
        return np.where(tail < 0, -1, self.find(n - 1, keys)[place])


def _before(numbers: np.ndarray, counts: np.ndarray, first: int) -> np.ndarray:
    """Each token's predecessor; ``first`` before a text's first word."""
    before = np.concatenate([[first], numbers[:-1]])
    before[np.cumsum(counts) - counts] = first
    return before


def _contexts(reader: Reader, numbers: np.ndarray, counts: np.ndarray, end: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, context, number) for n = 2 to ``most``: the numbers of the shorter n-gram
    that ends before each token and of the n-gram that ends there, -1 where there is
    none. The last has no numbers."""
    context = _before(numbers, counts, end)
    for n in range(2, most):
        found, both = np.full(len(numbers), -1, np.int64), (numbers >= 0) & (context >= 0)
        keys, place = np.unique(reader.key(context[both], numbers[both]), return_inverse=True)
        found[both] = reader.find(n, keys)[place]
        yield n, context, found
        context = _before(found, counts, -1)
    yield most, context, numbers[:0]


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Counts all texts of ``docs`` and writes the model's files; ``order`` is 2 at least."""
    if order < 2:
        raise ValueError(f"order {order} is below 2")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("_lm_text"))
    size = texts.agg(F.sum(F.coalesce(F.octet_length("_lm_text"), F.lit(0)) + 1)).first()[0] or 0
    folder = local_path(shared_path(spark, "lm"))
    n_ranges = max(4, -(-size // WORD_BYTES))
    edges = (np.arange(n_ranges, dtype=object) * (1 << 64) // n_ranges).astype(np.uint64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [], [], 0
        for batch in slices(batches, "_lm_text"):
            k, t = counted([tokens(*utf8(pick(batch, "_lm_text")))[0]])
            keys.append(k)
            times.append(t)
            held += len(k)
            if held > FLUSH_KEYS:
                yield from _parcels(*counted(keys, times), edges)
                keys, times, held = [], [], 0
        yield from _parcels(*counted(keys, times), edges)

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, keys, times = _merged(batches)
        if r is None:
            return
        os.makedirs(folder, exist_ok=True)
        _save(folder, f"hash-{r}", keys.astype("<u8"))
        _save(folder, f"count-{r}", times.astype("<u8"))
        at, part = _points(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(times.sum())], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([part], pa.list_(pa.float64()))],
            names=["r", "n", "total", "at", "part"])

    parcel = "r int, keys binary, times binary"
    found = (texts.mapInArrow(count_words, parcel).repartitionById(n_ranges, F.col("r"))
             .mapInArrow(save_words, "r int, n long, total long, at array<long>, part array<double>").orderBy("r").collect())  # one row for each range
    model = Model(folder, order, sum(w.total for w in found), [Level(edges, _bases(found, n_ranges))])
    if not found:
        return model
    if model.n_words >= 1 << 32:
        raise ValueError("over 2**32 distinct words")

    end = int(Reader(model).find(1, np.array([END]))[0])
    heads, few = (end, end + 1), []
    for n in range(2, order + 1):
        found = _count_grams(texts, model, n, found, end, max(4, -(-size // PAIR_BYTES)))
        # the heads of texts follow one another, as their contexts do
        heads = tuple(int(x) for x in _numbers_at(model, n, heads))
        model.levels[n - 1].heads = heads
        few = np.sum([np.zeros(4), *(x.few for x in found)], axis=0)
    model.levels[-1].off = discounts(few)
    for n in range(order, 1, -1):
        _sides(spark, model, n)
    return model


def _bases(found: list, n_ranges: int) -> np.ndarray:
    n_of = np.zeros(n_ranges, np.int64)
    for x in found:
        n_of[x.r] = x.n
    return np.concatenate([[0], np.cumsum(n_of)])


def _numbers_at(model: Model, n: int, contexts: tuple[int, int]) -> Iterator[int]:
    """The numbers of the first n-grams whose contexts are not below the given ones."""
    level, reader = model.levels[n - 1], Reader(model)
    for context in contexts:
        key = np.uint64(context) << model.shift
        r = max(int(np.searchsorted(level.edges, key, side="right")) - 1, 0)
        yield int(level.base[r]) + int(np.searchsorted(reader.table(f"gram{n}-{r}", "<u8"), key))


def _count_grams(texts: DataFrame, model: Model, n: int, shorter: list, end: int, n_ranges: int) -> list:
    """Writes the n-grams' keys and counts and adds their level to the model; one row for each range."""
    folder, below = model.folder, model.levels[-1].base
    if (max(int(below[-1]), 1) - 1).bit_length() + int(model.shift) > 64:
        raise ValueError(f"{below[-1]} contexts of {n}-grams and {model.n_words} words do not fit into 64 bits")
    # ranges: equal shares of the counted tokens, by context and then last word
    points = [(int(below[w.r]) + a, p, w.total / POINTS) for w in shorter for a, p in zip(w.at, w.part)]
    share, goal, starts = 0.0, sum(w.total for w in shorter) / n_ranges, [0]
    for number, part, mass in points:
        if share >= goal * len(starts):
            starts.append(number << int(model.shift) | int(part * model.n_words))
        share += mass
    edges = np.unique(np.array(starts, np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        held, size = [], 0
        for batch in slices(batches, "_lm_text"):
            hashes, counts = tokens(*utf8(pick(batch, "_lm_text")))
            distinct, place = np.unique(hashes, return_inverse=True)
            numbers = reader.find(1, distinct)[place]
            *_, (_, context, _) = _contexts(reader, numbers, counts, end, n)
            there = context >= 0
            held.append(reader.key(context[there], numbers[there]))
            size += len(held[-1])
            if size > FLUSH_KEYS:
                yield from _parcels(*counted(held), edges)
                held, size = [], 0
        yield from _parcels(*counted(held), edges)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, keys, times = _merged(batches)
        if r is None:
            return
        _save(folder, f"gram{n}-{r}", keys.astype("<u8"))
        _save_counts(folder, f"times{n}-{r}", times)
        at, part = _points(times)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(times.sum())], pa.int64()), pa.array([at], pa.list_(pa.int64())), pa.array([part], pa.list_(pa.float64())),
             pa.array([np.bincount(np.minimum(times, 5), minlength=6)[1:5].tolist()], pa.list_(pa.int64()))],
            names=["r", "n", "total", "at", "part", "few"])

    found = (texts.mapInArrow(count, "r int, keys binary, times binary").repartitionById(len(edges), F.col("r"))
             .mapInArrow(save, "r int, n long, total long, at array<long>, part array<double>, few array<long>").orderBy("r").collect())
    model.levels.append(Level(edges, _bases(found, len(edges))))
    return found


def _sides(spark, model: Model, n: int) -> None:
    """From the n-grams' counts, for each n-gram shorter by one: in how many contexts it
    occurs, its summed discounts as a context and, below the order, its summed counts as one."""
    folder, below, top = model.folder, model.levels[n - 2], n == model.order
    mine = f"times{n}" if top else f"left{n}"

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)

        def out(k: int, kind: str, numbers: bytes, values: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([kind]), pa.array([numbers], pa.binary()), pa.array([values], pa.binary())], names=["k", "kind", "numbers", "values"])

        for batch in batches:
            for r in pick(batch, "r").to_pylist():
                if r < 0:  # every range of the shorter ones is written, whether or not it gets a parcel
                    for k in np.flatnonzero(np.diff(below.base)).tolist():
                        yield out(k, "none", b"", b"")
                    continue
                base = model.levels[n - 1].base
                keys, times = np.asarray(reader.table(f"gram{n}-{r}", "<u8")), reader.of(n, mine, "u1", np.arange(base[r], base[r + 1]))
                first, word = reader.parts(keys)
                starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                few = [np.add.reduceat(np.minimum(times, 3) == c, starts, dtype=np.int64) for c in (1, 2, 3)]
                few = np.stack(few if top else [*few, np.add.reduceat(times, starts)], axis=1)
                if n == 2:
                    second, lefts = counted([word])
                else:
                    second, lefts = counted([reader.key(reader.tails(n - 1, first), word)])
                    second = reader.find(n - 1, second)  # rises with the key
                for kind, numbers, values in (("back", first[starts], few), ("left", second, lefts[:, None])):
                    at = np.searchsorted(numbers, below.base)
                    for k in np.flatnonzero(np.diff(at)).tolist():
                        part = slice(at[k], at[k + 1])
                        yield out(k, kind, squeeze(numbers[part].astype(np.uint64)), squeeze(values[part].astype(np.uint64).T.ravel()))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = None
        for batch in batches:
            for own, kind, numbers, values in zip(*(pick(batch, c).to_pylist() for c in ("k", "kind", "numbers", "values"))):
                if k is None:
                    k, start, size = own, int(below.base[own]), int(below.base[own + 1] - below.base[own])
                    back, left, total = np.zeros(size), np.zeros(size, np.int64), np.zeros(0 if top else size, np.int64)
                if kind == "none":
                    continue
                at = unsqueeze(numbers).astype(np.int64) - start
                if kind == "left":
                    left[at] += unsqueeze(values).astype(np.int64)
                else:
                    values = unsqueeze(values).reshape(3 if top else 4, -1)
                    back[at] += values[:3].T @ model.levels[n - 1].off[1:]
                    if not top:
                        total[at] += values[3].astype(np.int64)
        if k is None:
            return
        if n > 2:  # nothing stands before the head of a text
            heads = np.arange(max(below.heads[0], start), min(below.heads[1], start + size))
            left[heads - start] = Reader(model).of(n - 1, f"times{n - 1}", "u1", heads)
        _save(folder, f"back{n - 1}-{k}", back.astype("<f4"))
        _save_counts(folder, f"left{n - 1}-{k}", left)
        if not top:
            _save(folder, f"sum{n - 1}-{k}", total.astype("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array([np.bincount(np.minimum(left, 5), minlength=6)[1:5].tolist()], pa.list_(pa.int64())), pa.array([int((left >= 3).sum())], pa.int64())], names=["few", "many"])

    n_parts = len(model.levels[n - 1].edges)
    filled = np.flatnonzero(np.diff(model.levels[n - 1].base)).tolist()
    ranges = spark.createDataFrame([(0, -1), *((r, r) for r in filled)], "part int, r int").repartitionById(n_parts, F.col("part")).select("r")
    lefts = (ranges.mapInArrow(sides, "k int, kind string, numbers binary, values binary").repartitionById(len(below.edges), F.col("k"))
             .mapInArrow(save, "few array<long>, many long").collect())
    few, many = np.sum([x.few for x in lefts], axis=0), sum(x.many for x in lefts)
    below.off = discounts(few)
    if n == 2:
        model.back = float(below.off[1] * few[0] + below.off[2] * few[1] + below.off[3] * many)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_tokens, n_known, base_score and score (log10 probability)."""
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model.n_words else None
        for batch in slices(batches, text_col):
            hashes, counts = tokens(*utf8(pick(batch, text_col)))
            known, base, full = np.zeros(len(hashes), bool), np.zeros(len(hashes)), np.zeros(len(hashes))
            if reader:
                known, base, full = log_probabilities(reader, hashes, counts)
            yield pa.RecordBatch.from_arrays(
                [*(pick(batch, f.name) for f in rest), pa.array(counts.astype(np.int64)), pa.array(segment_sums(known.astype(np.int64), counts)), pa.array(segment_sums(base, counts)), pa.array(segment_sums(full, counts))],
                names=[*(f.name for f in rest), "n_tokens", "n_known", "base_score", "score"])

    more = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*rest, *more]))


def log_probabilities(reader: Reader, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each token is known, its smoothed unigram and its n-gram log10 probability."""
    model, words = reader.model, reader.model.levels[0]
    distinct, place = np.unique(hashes, return_inverse=True)
    number = reader.find(1, distinct)  # rises with the hash
    count, left = reader.of_any(1, "count", "<u8", number), reader.of_any(1, "left1", "u1", number)
    base = np.log10((count + 1) / (model.n_tokens + model.n_words + 1))
    n_pairs = int(model.levels[1].base[-1])
    lower = np.maximum(left - words.off[np.minimum(left, 3).astype(np.int64)], 0) / n_pairs + model.back / n_pairs / (model.n_words + 1)

    numbers, p = number[place], lower[place]
    for n, context, found in _contexts(reader, numbers, counts, int(number[np.searchsorted(distinct, END)]), model.order + 1):
        if n > model.order:
            break
        top = n == model.order
        times = reader.of_any(n, f"times{n}" if top else f"left{n}", "u1", found)
        total = reader.of_any(n - 1, *((f"sum{n - 1}", "<u8") if not top else ("count", "<u8") if n == 2 else (f"times{n - 1}", "u1")), context)
        back = reader.of_any(n - 1, f"back{n - 1}", "<f4", context)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (np.maximum(times - model.levels[n - 1].off[np.minimum(times, 3).astype(np.int64)], 0) + back * p) / total, p)
    return (number >= 0)[place], base[place], np.log10(p)


def digest(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = mod_of_id("doc_id", 7) == 2
    model = train(docs.where(~held_out), order=order)
    scored = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
