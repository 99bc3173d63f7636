"""BPE encoding and decoding by tree concatenation.

A text is split into units (special tokens, then the pieces of the byte-level
pattern), and units are encoded one by one. What cannot be split any further
is encoded as a tree:

* a unit over ``LEAF`` bytes is halved until its leaves are short, the leaves
  are encoded on their own, and neighbours are joined bottom up;
* a document over ``spread_chars`` characters is cut into parts that become
  rows of their own, so its parts are encoded by different tasks; the parts'
  encodings are then joined pairwise.

A join re-encodes a window around the seam and widens it until its outermost
items agree with what either side had there. For units, equal outermost tokens
prove the result: a token sequence is the encoding of its bytes if every pair
of neighbours is. For texts, a unit's start fixes all splitting to its right,
so an equal first and last unit do.

Defined results: a null text is encoded as the empty text (no ids); ids outside
the vocabulary are an error; repeated rows are encoded each on its own; an
empty table gives no rows; other columns pass through, whatever their names,
as long as the output column is not among them.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import pick, slices, with_rid

#: Longest unit, in bytes, that is encoded without halving.
LEAF = 64
#: Documents with more characters are encoded in parts by several tasks.
SPREAD_CHARS = 1 << 20
#: Units in each of the two generations that a worker remembers with their ids.
MEMO_UNITS = 150_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _char_class(test) -> str:
    """Code points under 0x250 that pass ``test``, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if test(chr(c)))


_LETTER = _char_class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBER = _char_class(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = _char_class(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
#: The byte-level splitting pattern for code points under 0x250, where classes can be listed.
_UNITS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


class _Memo(dict):
    """Ids of the units seen lately: a full generation becomes the old one."""

    def __init__(self, unit, short: int):
        self.unit, self.short, self.old = unit, short, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = _to_binary(self.unit(key))
        if len(key) <= self.short:
            if len(self) >= MEMO_UNITS:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Bpe:
    """Byte-level BPE read from a tokenizer file (JSON)."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space")
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.leaf = leaf
        self.rank = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in byte_of for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token in self.special:
            self.rank.pop(token.encode(), None)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*self.rank.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._short = tiktoken.Encoding("units", pat_str=r"(?s:.+)", mergeable_ranks=self.rank, special_tokens={}).encode_ordinary
        self._pieces = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._memo = _Memo(self.unit, leaf)

    # -- splitting ---------------------------------------------------------
    def units(self, text: str) -> list[str]:
        """The text's units in order; joined they are the text."""
        if self._special is None or not any(s in text for s in self.special):
            return self._plain_units(text)
        out: list[str] = []
        for k, piece in enumerate(self._special.split(text)):
            out += [piece] if k % 2 else self._plain_units(piece)
        return out

    def _plain_units(self, text: str) -> list[str]:
        if not text:
            return []
        if not _BEYOND.search(text):
            return _UNITS.findall(text)
        return [text[a:b] for _, (a, b) in self._pieces(text)]

    # -- one unit ----------------------------------------------------------
    def _merge(self, raw: bytes) -> list[int]:
        """Plain BPE of a short byte string: merge the lowest-ranked pair, leftmost first."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def tree(self, raw: bytes) -> list[int]:
        """BPE of a long byte string: leaves on their own, joined level by level."""
        level = [self._merge(raw[i:i + self.leaf]) for i in range(0, len(raw), self.leaf)]
        while len(level) > 1:
            level = [self._seam(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def _seam(self, left: list[int], right: list[int]) -> list[int]:
        """The encodings of two neighbouring byte strings, joined exactly."""
        wide = 2
        while True:
            a, b = left[-wide:], right[:wide]
            raw = b"".join(map(self.bytes_of.__getitem__, a + b))
            mid = self._merge(raw) if len(raw) <= 4 * self.leaf else self._merge_long(raw)
            if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
                return left[:len(left) - len(a)] + mid + right[len(b):]
            wide *= 2

    def _merge_long(self, raw: bytes) -> list[int]:
        """Plain BPE in O(n log n): a heap of pairs over a linked list."""
        import heapq

        part = [raw[i:i + 1] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap = [(r, i, 2) for i in range(len(raw) - 1) if (r := self.rank.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, n = heapq.heappop(heap)
            j = after[i] if part[i] else len(raw)
            if j >= len(raw) or not part[i] or len(part[i]) + len(part[j]) != n or self.rank.get(part[i] + part[j]) != r:
                continue
            part[i], part[j] = part[i] + part[j], b""
            after[i] = after[j]
            if after[i] < len(raw):
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < len(raw) and (r := self.rank.get(part[x] + part[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, len(part[x]) + len(part[after[x]])))
        return [self.rank[p] for p in part if p]

    def unit(self, unit: str) -> list[int]:
        if unit in self.special:
            return [self.special[unit]]
        if len(unit) <= self.leaf and len(raw := unit.encode()) <= self.leaf:
            return self._short(unit) if len(raw) > 1 else [self.rank[raw]]
        return self.tree(unit.encode())

    # -- texts -------------------------------------------------------------
    def ids(self, units: list[str]) -> bytes:
        """Ids of units as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._memo.__getitem__, units))

    def encode(self, text: str | None) -> bytes:
        return self.ids(self.units(text or ""))

    def cut(self, text: str, part_chars: int) -> list[str]:
        """Parts of about ``part_chars`` characters, none ending inside a special token."""
        inside = [m.span() for m in self._special.finditer(text)] if self._special else []
        out, at = [], 0
        while at < len(text):
            to = min(len(text), at + part_chars)
            to = next((b for a, b in inside if a < to < b), to)
            out.append(text[at:to])
            at = to
        return out

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Units of two neighbouring texts, joined exactly."""
        wide = 2
        while True:
            a, b = left[-wide:], right[:wide]
            mid = self.units("".join(a + b))
            if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
                return left[:len(left) - len(a)] + mid + right[len(b):]
            wide *= 2

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One tokenizer for each file and worker process, with what it remembers."""
    return Bpe(path)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _to_binary(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _add_to_schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"column {name} is there already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, text_col: str, path: str, ids_col: str = "ids", spread_chars: int = SPREAD_CHARS, then=None, then_schema: str | None = None) -> DataFrame:
    """``df`` with its texts' ids as little-endian unsigned 32-bit integers (binary).

    ``then``, a function of Arrow batches whose result has ``then_schema``, is
    applied to them in the same Python worker, so that texts and ids do not go
    back and a task needs no second worker."""
    schema = _add_to_schema(df, ids_col, T.BinaryType())

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text_col):
            texts = pick(batch, text_col).to_pylist()
            yield _with_column(batch, ids_col, pa.array(list(map(bpe.encode, texts)), pa.binary()))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(ids(batches)) if then else ids(batches)

    long_one = F.length(text_col) > spread_chars
    out = df.where(~F.coalesce(long_one, F.lit(False))).mapInArrow(short, then_schema if then else schema)
    if spread_chars >= 1 << 30:
        return out
    rest = _encode_long(df.where(long_one), text_col, path, ids_col, spread_chars, schema)
    return out.unionByName(rest.mapInArrow(then, then_schema) if then else rest)


def _encode_long(df: DataFrame, text_col: str, path: str, ids_col: str, part_chars: int, schema: T.StructType) -> DataFrame:
    """The same for long documents: parts as rows, then the joins of each document.

    Part texts go to the tasks as rows; what comes back for a document are
    its units, joined pairwise, so only one document's units meet in a task.
    """
    rows = with_rid(df, "_bpe_rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text_col):
            for rid, text in zip(pick(batch, "_bpe_rid").to_pylist(), pick(batch, text_col).to_pylist()):
                for k, part in enumerate(bpe.cut(text, part_chars)):
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([k]), pa.array([part])], names=["_bpe_rid", "_bpe_k", "_bpe_part"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, "_bpe_part"):
            units = [bpe.units(t) for t in pick(batch, "_bpe_part").to_pylist()]
            ids = [[_to_binary(bpe.unit(u)) for u in us] for us in units]
            yield pa.RecordBatch.from_arrays(
                [pick(batch, "_bpe_rid"), pick(batch, "_bpe_k"), pa.array(units, pa.list_(pa.string())), pa.array(ids, pa.list_(pa.binary()))],
                names=["_bpe_rid", "_bpe_k", "_bpe_units", "_bpe_ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for rid, parts in zip(pick(batch, "_bpe_rid").to_pylist(), pick(batch, "_bpe_parts").to_pylist()):
                known = {u: i for p in parts for u, i in zip(p["_bpe_units"], p["_bpe_ids"])}
                level = [p["_bpe_units"] for p in parts]
                while len(level) > 1:
                    level = [bpe.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
                ids = b"".join(known[u] if u in known else _to_binary(bpe.unit(u)) for u in level[0])
                yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([ids], pa.binary())], names=["_bpe_rid", ids_col])

    parts = rows.select("_bpe_rid", text_col).mapInArrow(cut, "_bpe_rid long, _bpe_k long, _bpe_part string")
    done = parts.repartition("_bpe_rid", "_bpe_k").mapInArrow(split, "_bpe_rid long, _bpe_k long, _bpe_units array<string>, _bpe_ids array<binary>")
    whole = (done.groupBy("_bpe_rid")
             .agg(F.array_sort(F.collect_list(F.struct("_bpe_k", "_bpe_units", "_bpe_ids"))).alias("_bpe_parts"))
             .mapInArrow(join, f"_bpe_rid long, `{ids_col}` binary"))
    return rows.join(whole, "_bpe_rid").select(*[F.col(f"`{c}`") for c in schema.names])


def decode(df: DataFrame, ids_col: str, path: str, text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids (binary as from ``encode``; null counts as none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, ids_col):
            texts = list(map(bpe.decode, pick(batch, ids_col).to_pylist()))
            yield _with_column(batch, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _add_to_schema(df, text_col, T.StringType()))


def digest(docs: DataFrame, path: str, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = encode(docs.select("doc_id", "text"), "text", path, "ids", spread_chars)
    back = decode(done.select("doc_id", "ids"), "ids", path, "decoded")
    return back.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
