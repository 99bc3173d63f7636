"""Best-fit packing by exact complements.

Documents become pieces of at most ``CAPACITY`` tokens. Only their lengths
matter for the packing, so the plan is made from the counts by length, at most
``CAPACITY`` numbers: for the longest length left, combinations of one, two or
three lengths that exactly fill its gap are looked up by their sum, in tables
built from the lengths there are, and used as often as all of them are
available. The tables hold at most ``CAPACITY`` ** 2 numbers together. What finds no complement is placed by best
fit. The plan is a list of patterns with how often each is used, and is bounded
by the capacity, not by the corpus.

Pieces of one length are then numbered (in salted groups, so that a frequent
length is spread over many tasks), and a piece's number tells its pattern,
sequence and offset.

Defined results: a null text is empty, and an empty text is one piece that
holds the end id alone; a null id is carried through; repeated rows are packed
each; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import bpe
from pagemill.llm.common import materialise, pick, with_rid

#: Tokens in a sequence.
CAPACITY = 2048
#: The id after each document.
END_ID = 0
#: Pieces of one length that are numbered in one group.
GROUP_ROWS = 20_000


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces of one document; only the first may be shorter."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, ids[4 * a:4 * b]) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The documents' pieces: ``_bp_rid``, ``_bp_id``, piece, start, length, ids_crc32."""
    rows = with_rid(docs.select(F.col(id_col).alias("_bp_id"), F.col(text_col).alias("_bp_text")), "_bp_rid")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(pick(batch, "_bp_ids").to_pylist()):
                for k, (a, part) in enumerate(cut(ids + end, capacity)):
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "_bp_rid").take(at), pick(batch, "_bp_id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_bp_rid", "_bp_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(rows.dtypes)["_bp_id"]
    return bpe.encode(rows, "_bp_text", path, "_bp_ids", then=run, then_schema=f"_bp_rid long, _bp_id {kind}, piece int, start long, length long, ids_crc32 long")


def pair_sums(lengths: np.ndarray, capacity: int) -> dict[int, np.ndarray]:
    """sum -> the longer members of the pairs of ``lengths`` (ascending) that add up to it, longest first."""
    long, short = np.meshgrid(lengths, lengths, indexing="ij")
    ok = (short <= long) & (long + short < capacity)
    long, total = long[ok], (long + short)[ok]
    order = np.lexsort((-long, total))
    long, total = long[order].astype(np.int32), total[order]
    sums, first = np.unique(total, return_index=True)
    return dict(zip(sums.tolist(), np.split(long, first[1:])))


def triple_sums(lengths: np.ndarray, pairs: dict[int, np.ndarray], capacity: int) -> dict[int, np.ndarray]:
    """sum -> the longest members of the triples that add up to it, longest first;
    the other two are a pair in ``pairs`` with no longer member."""
    least = np.full(capacity + 1, capacity + 1)
    for total, long in pairs.items():
        least[total] = long[-1]
    down, out = lengths[::-1].astype(np.int32), {}
    for total in range(3, capacity):
        long = down[down < total]
        long = long[least[total - long] <= long]
        if len(long):
            out[total] = long
    return out


class Supply:
    """How many pieces of each length are left, and tables from sums to the
    combinations of two and three lengths that make them.

    The tables are built once from the lengths at hand. Supplies only shrink, so
    what is no longer available leaves its table when it is met and is not met
    again. A sum's triples serve the one length whose gap it is.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        lengths = np.flatnonzero(self.left[:capacity])
        self.pairs = pair_sums(lengths, capacity)
        self.triples = triple_sums(lengths, self.pairs, capacity)

    def _free(self, aside: tuple[int, ...]) -> np.ndarray:
        free = self.left.copy()
        np.subtract.at(free, list(aside), 1)
        return free

    def single(self, total: int, aside: tuple[int, ...] = ()):
        return (total,) if self._free(aside)[total] > 0 else None

    def pair(self, total: int, aside: tuple[int, ...] = (), most: int | None = None):
        """Two lengths with this sum, the longer one as long as there is and at most
        ``most``; ``aside`` is taken already."""
        row = self.pairs.get(total)
        if row is None:
            return None
        both = np.where(2 * row == total, 2, 1)
        held = (self.left[row] >= both) & (self.left[total - row] > 0)
        if not held.all():
            row, both = row[held], both[held]
            if not len(row):
                del self.pairs[total]
                return None
            self.pairs[total] = row
        free = self._free(aside)
        ok = (free[row] >= both) & (free[total - row] > 0)
        if most is not None:
            ok &= row <= most
        at = int(ok.argmax())
        return (int(row[at]), total - int(row[at])) if ok[at] else None

    def triple(self, total: int, aside: tuple[int, ...] = ()):
        row = self.triples.pop(total, np.zeros(0, np.int32))
        free = self._free(aside)
        for k, a in enumerate(row.tolist()):
            rest = self.pair(total - a, (*aside, a), a) if free[a] > 0 else None
            if rest:
                self.triples[total] = row[k:]
                return (a, *rest)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Uses the combination as often as it can; how often."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= times * n
        return times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with how many sequences follow it."""
    supply, out = Supply(counts, capacity), []
    if supply.left[capacity]:
        out.append(((capacity,), supply.take((capacity,))))
    for length in range(capacity - 1, 0, -1):
        while supply.left[length]:
            gap, own = capacity - length, (length,)
            fill = supply.single(gap, own) or supply.pair(gap, own) or supply.triple(gap, own)
            if not fill:
                break
            times = supply.take((length, *fill))
            if not times:
                break
            out.append(((length, *fill), times))
    return out + best_fit({x: int(n) for x, n in enumerate(supply.left) if n}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over groups of equally filled sequences."""
    room: dict[int, list[list]] = {}  # space left -> [pattern, times]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [s for s in room if s >= length]
            if not fits:
                each = capacity // length
                for per, times in ((each, left // each), (left % each, 1)):
                    if per and times:
                        room.setdefault(capacity - per * length, []).append([(length,) * per, times])
                break
            space = min(fits)
            group = room[space][-1]
            times = min(left, group[1])
            group[1] -= times
            if not group[1]:
                room[space].pop()
                if not room[space]:
                    del room[space]
            room.setdefault(space - length, []).append([(*group[0], length), times])
            left -= times
    return [(tuple(pattern), times) for groups in room.values() for pattern, times in groups]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first number, sequence of that number, offset) of its runs, in order."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack(items: DataFrame, length_col: str = "length", key_col: str = "_bp_rid", capacity: int = CAPACITY) -> DataFrame:
    """``items`` (written tables, lengths 1 to capacity) plus ``sequence_id`` and ``offset``."""
    counts = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    slots = items.sparkSession.sparkContext.broadcast(_slots(plan(counts, capacity)))

    salts = max(8, sum(counts.values()) // (GROUP_ROWS * 8))
    salted = items.withColumn("_bp_salt", F.pmod(F.xxhash64(key_col, *[c for c in ("piece",) if c in items.columns]), F.lit(salts)))
    sizes = salted.groupBy(length_col, "_bp_salt").agg(F.count(F.lit(1)).alias("_bp_n"))
    before = sizes.withColumn("_bp_base", F.sum("_bp_n").over(Window.partitionBy(length_col).orderBy("_bp_salt")) - F.col("_bp_n")).drop("_bp_n")
    order = Window.partitionBy(length_col, "_bp_salt").orderBy(key_col, *[c for c in ("piece",) if c in items.columns])
    numbered = (salted.withColumn("_bp_no", F.row_number().over(order).cast("long"))
                .join(before, [length_col, "_bp_salt"])
                .select(*items.columns, (F.col("_bp_no") - 1 + F.col("_bp_base")).alias("_bp_no")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, no = pick(batch, length_col).to_numpy(), pick(batch, "_bp_no").to_numpy()
            sequence, offset = np.zeros(len(no), np.int64), np.zeros(len(no), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, seq, off = slots.value[x]
                run = np.searchsorted(first, no[at], side="right") - 1
                sequence[at], offset[at] = seq[run] + no[at] - first[run], off[run]
            rest = [c for c in batch.schema.names if c != "_bp_no"]
            yield pa.RecordBatch.from_arrays([*(pick(batch, c) for c in rest), pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in items.dtypes)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = pack(materialise(pieces(docs, path), "pieces"))
    return packed.select(F.col("_bp_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' pieces with their places."""
    from pagemill.llm.queries import tokenizer

    return digest(docs, tokenizer())
