"""Training-order materialisation: token shards of fixed stride in a keyed order.

Every scan partition's documents are encoded, each followed by the end id, and
cut into sequences of ``length`` tokens (the last of a partition is padded). A
sequence's index is its place in its partition plus that partition's base; the
bases come from the texts' byte counts, which bound the token counts, so one
pass over the texts is enough. A keyed Feistel network over the index range,
walking cycles until it is back in range, gives every sequence its slot. Slots
are dealt out by range; each range is one shard, written in slot order as
records of equal size, so that the sequence at any place of the training order
is found by arithmetic, and a reader that stopped goes on where it was.

Ranges are of equal width in slots, and positions in the training order are
dense: a shard's first position is the number of sequences in the shards
before it.

``read`` gives the sequences from any position on, so a training run that stopped
goes on where it was; with the manifest kept beside the shards it needs nothing else.

A shard is written under another name and renamed, so a task that is run again
replaces its file whole. The order depends on the key and on how the input is
split into partitions.

Defined results: null texts are empty and give the end id alone; repeated rows
are kept; an empty table gives no shards; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import bpe
from pagemill.llm.common import materialise, mix, pick, shared_path, slices, with_rid

#: Tokens in a sequence.
LENGTH = 1024
#: Sequences' index range that one shard covers.
SHARD_SLOTS = 1 << 15
#: The id after each document, and what fills a partition's last sequence.
END_ID, PAD_ID = 50256, 50256
#: The order's key.
KEY = 20240229
#: Positions that a reading task takes in one run, and records it hands on at once.
STRETCH, READ_ROWS = 1 << 12, 1 << 10
#: Rounds of the Feistel network.
ROUNDS = 6


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0..n-1, at the given places."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key & (1 << 64) - 1) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return left << np.uint64(half) | right

    out = np.asarray(index).astype(np.uint64)
    out = network(out)
    outside = out >= np.uint64(n)
    while outside.any():
        out[outside] = network(out[outside])
        outside = out >= np.uint64(n)
    return out.astype(np.int64)


def sequences(docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, pad_id: int = PAD_ID) -> tuple[DataFrame, int]:
    """(index, n_tokens, ids) of all sequences, and the end of the index range."""
    rows = with_rid(docs.select(F.col(text_col).alias("_tm_text")), "_tm_rid").withColumn("_tm_part", F.shiftright("_tm_rid", 33))
    # a text has at most as many tokens as bytes, and one end id
    most = rows.groupBy("_tm_part").agg(F.ceil((F.sum(F.coalesce(F.octet_length("_tm_text"), F.lit(0)) + 1)) / F.lit(length)).alias("n")).orderBy("_tm_part")
    parts = most.collect()  # one number for each scan partition
    bases, total = {}, 0
    for part, n in parts:
        bases[part], total = total, total + n
    kind, end = _kind(path), np.array([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held, at, part = bpe.load(path), np.zeros(0, kind), 0, None

        def out(ids: np.ndarray, first: int, full: list[int]) -> pa.RecordBatch:
            raw, wide = ids.tobytes(), length * ids.itemsize
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + len(full))), pa.array(full, pa.int32()), pa.array([raw[i * wide:(i + 1) * wide] for i in range(len(full))], pa.binary())],
                names=["index", "n_tokens", "ids"])

        for batch in slices(batches, "_tm_text", 1 << 20):
            if part is None:
                part = pick(batch, "_tm_part")[0].as_py()
                at = bases[part]
            held = np.concatenate([held, *(x for t in pick(batch, "_tm_text").to_pylist() for x in (np.frombuffer(tokens.encode(t), "<u4").astype(kind), end.astype(kind)))])
            n = len(held) // length
            if n:
                yield out(held[:n * length], at, [length] * n)
                held, at = held[n * length:], at + n
        if len(held):
            yield out(np.concatenate([held, np.full(length - len(held), pad_id, kind)]), at, [len(held)])

    return rows.select("_tm_text", "_tm_part").mapInArrow(run, "index long, n_tokens int, ids binary"), total


def _kind(path: str) -> str:
    return "<u2" if len(bpe.load(path).bytes_of) <= 1 << 16 else "<u4"


def write(docs: DataFrame, path: str, to: str, text_col: str = "text", length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """Writes the shards under ``to`` (a path all executors share) and returns the
    manifest: position, shard, offset (bytes), n_tokens, crc32, sequence_index.
    """
    rows, total = sequences(docs, path, text_col, length, end_id, pad_id)
    n_shards = max(1, -(-total // shard_slots))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(pick(batch, "index").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_slots), pa.array(slot), *batch.columns], names=["shard", "slot", *batch.schema.names])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(to)
        now, file, at = None, None, 0

        def close():
            file.close()
            store.move(f"{folder}/shard-{now:06d}.tmp-{mark}", f"{folder}/shard-{now:06d}.bin")

        for batch in batches:
            crc, place = [], []
            for shard, ids in zip(pick(batch, "shard").to_pylist(), pick(batch, "ids").to_pylist()):
                if shard != now:
                    if file:
                        close()
                    now, at = shard, 0
                    mark = np.random.default_rng().integers(1 << 60)
                    file = store.open_output_stream(f"{folder}/shard-{now:06d}.tmp-{mark}")
                file.write(ids)
                crc.append(zlib.crc32(ids))
                place.append(at)
                at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "shard"), pick(batch, "slot"), pa.array(place, pa.int64()), pick(batch, "n_tokens"), pa.array(crc, pa.int64()), pick(batch, "index")],
                names=["shard", "slot", "offset", "n_tokens", "crc32", "sequence_index"])
        if file:
            close()

    store, folder = fs.FileSystem.from_uri(to)
    store.create_dir(folder)
    dealt = rows.mapInArrow(deal, "shard long, slot long, index long, n_tokens int, ids binary")
    sorted_rows = dealt.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    saved = materialise(sorted_rows.mapInArrow(save, "shard long, slot long, offset long, n_tokens int, crc32 long, sequence_index long"), "shard-manifest")
    width = length * np.dtype(_kind(path)).itemsize
    sizes = saved.groupBy("shard").agg(F.count(F.lit(1)).alias("_tm_n"))
    before = sizes.select("shard", (F.sum("_tm_n").over(Window.orderBy("shard")) - F.col("_tm_n")).alias("_tm_first"))
    return saved.join(before, "shard").select((F.col("_tm_first") + (F.col("offset") / width).cast("long")).alias("position"), "shard", "offset", "n_tokens", "crc32", "sequence_index")


def keep_manifest(manifest: DataFrame, to: str) -> DataFrame:
    """Stores the manifest beside its shards, and gives it back as read from there."""
    manifest.write.mode("overwrite").parquet(f"{to}/manifest")
    return manifest.sparkSession.read.parquet(f"{to}/manifest")


def read(manifest: DataFrame, to: str, path: str, from_position: int = 0, length: int = LENGTH, stretch: int = STRETCH) -> DataFrame:
    """(position, n_tokens, ids) of the sequences from a position of the training
    order on, ids as little-endian unsigned integers of 16 or 32 bits, padded.

    Tasks read stretches of the order: a stretch is a run of records in one shard
    or in a few that follow each other. A record of another check sum than the
    manifest's, or one cut short, is an error. Past the end there are no rows.
    """
    width = length * np.dtype(_kind(path)).itemsize
    rows = manifest.where(F.col("position") >= from_position).select("position", "shard", "offset", "n_tokens", "crc32")
    placed = rows.repartition(F.floor(F.col("position") / stretch)).sortWithinPartitions("position")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(to)
        now, file = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, READ_ROWS):
                part, ids = batch.slice(begin, READ_ROWS), []
                for shard, offset, crc in zip(pick(part, "shard").to_pylist(), pick(part, "offset").to_pylist(), pick(part, "crc32").to_pylist()):
                    if shard != now:
                        if file:
                            file.close()
                        now, file = shard, store.open_input_file(f"{folder}/shard-{shard:06d}.bin")
                    raw = file.read_at(width, offset)
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"shard {shard}, offset {offset}: not the record that was written")
                    ids.append(raw)
                yield pa.RecordBatch.from_arrays([pick(part, "position"), pick(part, "n_tokens"), pa.array(ids, pa.binary())], names=["position", "n_tokens", "ids"])
        if file:
            file.close()

    return placed.mapInArrow(load, "position long, n_tokens int, ids binary")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """One row per sequence in training order: position, shard, offset, n_tokens, crc32, sequence_index."""
    to = shared_path(docs.sparkSession, "shards")
    return write(docs, path, to if "://" in to or to.startswith("file:") else f"file://{to}")
