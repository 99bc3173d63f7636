"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import checkpoint_dir

#: Text bytes handled at once by the numpy kernels; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch between Spark and its Python workers, at most.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as a worker holds several of them next to its model."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{1 << 30}b")
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later
    stages restart from these files when executors are lost."""
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_splits(spark: SparkSession) -> None:
    """Fixes into how many partitions a file scan is cut at least. Otherwise that
    follows the executors registered at the time, and a second scan, after one
    came or went, would give the same rows other numbers."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or str(spark.sparkContext.defaultParallelism))


def with_rid(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number the rows. ``df`` must be a file scan or a narrow step on one, so
    that a recomputed partition gives the same rows in the same order."""
    small_batches(df.sparkSession)
    pin_splits(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1, from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes (one row at least)."""
    for batch in batches:
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for every (start, length), concatenated."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(starts.astype(np.int64) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return out + np.arange(total, dtype=np.int64)


def pick(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mod_of_id(column, n: int):
    """crc32 of the id as text, mod n (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, modulo 2**64, of the base and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.empty(n + 1, np.uint64)
        table[0] = 1
        np.multiply.accumulate(np.full(n, base, np.uint64), out=table[1:])
        out.append(table)
    return out[0], out[1]


def prefix_hashes(raw: np.ndarray, seed: int = 1) -> np.ndarray:
    """Sums of random byte values times powers of the base, up to each place."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    powers, _ = _powers(max(len(raw), SLICE_BYTES))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * powers[:len(raw)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte range [start, end), from ``prefix_hashes``."""
    _, back = _powers(max(len(sums) - 1, SLICE_BYTES))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def byte_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of every byte range [start, end)."""
    return range_hashes(prefix_hashes(raw, seed), starts, ends)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one value."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    return starts, np.concatenate([starts[1:], [len(kind)]])


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``counts`` rows (0 for empty groups)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def squeeze(values: np.ndarray) -> bytes:
    """An integer array in little room: differences, byte planes, zstd."""
    import zstandard

    values = np.ascontiguousarray(values)
    steps = np.diff(values, prepend=values.dtype.type(0))  # modulo its width
    planes = steps.view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes())


def unsqueeze(packed: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(kind.itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(kind), dtype=kind)


def arrow_uri(path: str) -> str:
    """A path of the shared folder as pyarrow opens it."""
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def beside(side: DataFrame, rid: str, name: str) -> str:
    """Writes rows about numbered rows to one folder for each scan partition, so that
    the task that scans it finds them there and texts need no shuffle."""
    path = shared_path(side.sparkSession, name)
    side.withColumn("_scan", F.shiftright(rid, 33)).repartition("_scan").write.partitionBy("_scan").parquet(path)
    return arrow_uri(path)


def own_rows(path: str, part: int) -> pa.Table | None:
    """The rows that ``beside`` wrote for one scan partition."""
    store, folder = fs.FileSystem.from_uri(path)
    files = [f for f in store.get_file_info(fs.FileSelector(f"{folder}/_scan={part}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(store.open_input_file(f.path)) for f in files]) if files else None


def local_path(path: str) -> str:
    """The path of a shared folder as the workers' file system sees it."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: spark.checkpoint.dir must name a mounted folder here, as workers map files from it")
    return path
