"""WARC archives in Zstandard: written record by record, read frame by frame.

An archive is a leading skippable frame that holds a dictionary, and then one
Zstandard frame for each record.

Writing: every scan task writes archives of its own, of at most ``ARCHIVE_BYTES``
of payload, into the shared folder. An archive's dictionary is trained on its own
first records (``TRAIN_BYTES`` at most; it changes its size, never what is read
back); one with too few has no leading frame. Names are new for every attempt
and only those that a finished task reports are read, so what a lost executor
left behind does not count. Of equal payloads of ``LEAST`` bytes and more the
one with the least id is written; the others become revisits that name it.
Which these are is decided on digests, so payloads are not shuffled.

Reading: one task walks an archive from frame to frame by the block sizes,
without decoding, and hands on stretches of ``SPAN_BYTES``. Tasks then decode
stretches, with the dictionary of the leading frame, one frame at a time, and
check each record: one whole frame, the version line, the fields that must be
there, once each, the block's length and its end, and both digests. A record that
fails is a row with ``error`` set, and so is what cannot be walked, or a stretch
whose dictionary cannot be read.

Revisits have no payload. Its length comes from their HTTP head, its digest from
their header, and ``resolve`` holds both against the record they refer to.

Defined results: a null payload is empty; a null id sorts after all others and
stays null; of repeated ids with equal payloads the first in input order is the
response; a null or empty address is written as ``about:blank``, and control
characters and blanks in one are percent-encoded; an empty table gives no
archives and no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_uri, beside, materialise, own_rows, pick, shared_path, slices, small_batches, with_rid

#: Payload bytes of an archive, those that its dictionary is trained on, and archive bytes decoded by one task at a time.
ARCHIVE_BYTES, TRAIN_BYTES, SPAN_BYTES = 64 << 20, 4 << 20, 8 << 20
#: Most bytes of a dictionary, and payload bytes from which on equal payloads become revisits.
DICT_BYTES, LEAST = 1 << 16, 100
#: Date of records whose capture time is not known.
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
DICT_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = b"\x28\xb5\x2f\xfd"
DICT = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MUST = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORD = ("archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, page_id string, warc_date string, "
          "payload binary, payload_bytes long, payload_digest string, error string")


# ---- writing

def _record_id(run: str, rid: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{run}/{rid}')}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def record(record_id: str, page_id, url: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One WARC record: a response, or a revisit where ``refers_to`` names one."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    size = min(DICT_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8) if size >= 1024 else None
    except zstandard.ZstdError:  # too few or too uniform samples
        return None


class _Archive:
    """An archive that is being written. Records wait until there are enough to train its dictionary on."""

    def __init__(self, store, path: str, uri: str):
        self.uri, self.out = uri, store.open_output_stream(path, compression=None)
        self.waiting, self.held, self.records, self.payload, self.size = [], 0, 0, 0, 0
        self.press = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _start(self) -> None:
        trained = _trained(self.waiting)
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            self._put(struct.pack("<II", DICT_FRAME, len(packed)) + packed)
        self.press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True) if trained else zstandard.ZstdCompressor(level=3, write_checksum=True)
        for data in self.waiting:
            self._put(self.press.compress(data))
        self.waiting = []

    def add(self, data: bytes, payload: int) -> None:
        self.records, self.payload = self.records + 1, self.payload + payload
        if self.press:
            self._put(self.press.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= TRAIN_BYTES:
            self._start()

    def close(self) -> pa.RecordBatch:
        if not self.press:
            self._start()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.uri]), pa.array([self.records], pa.int64()), pa.array([self.size], pa.int64())], names=["archive", "records", "bytes"])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = DATE) -> DataFrame:
    """Writes one record for each row; (archive, records, bytes), one row for each archive."""
    rows = with_rid(pages.select(F.col(id_col).alias("_wa_id"), F.col(url_col).cast("string").alias("_wa_url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("_wa_body")), "_wa_rid")
    keys = rows.where(F.octet_length("_wa_body") >= least).select("_wa_rid", "_wa_id", F.unhex(F.sha2("_wa_body", 256)).alias("_wa_key"))
    keys = materialise(keys, "warc-keys")
    # written first, so that a join with a hot payload is split
    first = F.min(F.struct(F.col("_wa_id").isNull().alias("none"), F.col("_wa_id").alias("id"), F.col("_wa_rid").alias("rid")))
    several = materialise(keys.groupBy("_wa_key").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1").select("_wa_key", F.col("first.rid").alias("_wa_first")), "warc-several")
    again = beside(keys.join(several, "_wa_key").where("_wa_rid != _wa_first").select("_wa_rid", "_wa_first"), "_wa_rid", "warc-revisits")
    folder = shared_path(pages.sparkSession, "warc")
    uri, run = arrow_uri(folder), folder.rsplit("-", 1)[-1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        mine, archive, k = None, None, 0
        for batch in slices(batches, "_wa_body"):
            rid = pick(batch, "_wa_rid").to_pylist()
            if mine is None:
                store.create_dir(root, recursive=True)
                own = own_rows(again, rid[0] >> 33)
                mine = dict(zip(own.column("_wa_rid").to_pylist(), own.column("_wa_first").to_pylist())) if own else {}
            for r, page, url, body in zip(rid, *(pick(batch, c).to_pylist() for c in ("_wa_id", "_wa_url", "_wa_body"))):
                if archive is None:
                    name = f"{r >> 33:06d}-{k:04d}-{uuid.uuid4().hex}.warc.zst"
                    archive, k = _Archive(store, f"{root}/{name}", f"{uri}/{name}"), k + 1
                archive.add(record(_record_id(run, r), page, url, body, _record_id(run, mine[r]) if r in mine else None, date), len(body))
                if archive.payload >= ARCHIVE_BYTES:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return materialise(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


# ---- reading

def frame_end(data, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block sizes; -1 if ``data`` ends before."""
    if len(data) < at + 18:  # the longest frame head
        if len(data) < at + 6 or len(data) < at + zstandard.frame_header_size(bytes(data[at:])):
            return -1
    parameters = zstandard.get_frame_parameters(bytes(data[at:at + 18]))
    end = at + zstandard.frame_header_size(bytes(data[at:at + 18]))
    while True:
        if len(data) < end + 3:
            return -1
        block = int.from_bytes(data[end:end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a block of one repeated byte holds that byte
        if block & 1:
            end += 4 if parameters.has_checksum else 0
            return end if end <= len(data) else -1


def walk(source, size: int, most: int) -> Iterator[tuple[int, int, str | None]]:
    """(from, to, None) for stretches of whole record frames of about ``most`` bytes;
    (from, size, what is wrong) where an archive cannot be walked on."""
    held, base, start, at = bytearray(), 0, None, 0  # held[0] is at base; at is the frame looked at
    while True:
        need, wrong = 1 << 16, None
        while True:
            here = at - base
            magic = bytes(held[here:here + 4])
            end = -1
            try:
                if len(magic) == 4 and int.from_bytes(magic, "little") in SKIPPABLE:
                    end = here + 8 + int.from_bytes(held[here + 4:here + 8], "little") if len(held) >= here + 8 else -1
                    end = end if end <= len(held) else -1
                elif magic == FRAME:
                    end = frame_end(held, here)
                elif len(magic) == 4:
                    wrong = "no frame starts here"
            except zstandard.ZstdError as error:
                wrong = str(error)
            if end >= 0 or wrong:
                break
            more = source.read(need)
            if not more:
                wrong = "the archive ends within a frame" if len(held) > here else ""
                break
            held += more
            need *= 2
        if wrong is not None:
            if start is not None and start < at:
                yield start, at, None
            if wrong:
                yield at, size, wrong
            return
        skip = magic != FRAME
        if skip and start is not None:
            yield start, at, None
            start = None
        if not skip and start is None:
            start = at
        at = base + end
        if start is not None and at - start >= most:
            yield start, at, None
            start = None
        if at - base > 1 << 20:
            del held[:at - base]
            base = at


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary in the leading skippable frame, if an archive starts with one; it may be compressed itself."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != DICT_FRAME:
        return None
    body = data[8:8 + int.from_bytes(data[4:8], "little")]
    if body[:4] == FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if body[:4] != DICT:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body)


def _lead(source) -> tuple[zstandard.ZstdCompressionDict | None, str | None]:
    """An archive's dictionary, and what is wrong with it."""
    head = source.read_at(8, 0)
    try:
        whole = int.from_bytes(head[:4], "little") == DICT_FRAME
        return (dictionary(head + source.read_at(int.from_bytes(head[4:8], "little"), 8)) if whole else None), None
    except (ValueError, zstandard.ZstdError) as error:
        return None, str(error)


def decode(data: bytes, known: zstandard.ZstdCompressionDict | None) -> bytes:
    """The content of exactly one frame."""
    reader = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompressobj()
    out = reader.decompress(data)
    if not reader.eof or reader.unused_data:
        raise ValueError("not one whole frame")
    return out


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        key = name.decode("ascii", "strict").lower()
        if not colon or not key or key.strip() != key:
            raise ValueError(f"bad header line {line[:80]!r}")
        if key in out and key != "warc-concurrent-to":
            raise ValueError(f"{key} more than once")
        out[key] = value.decode("utf-8").strip(" \t")
    return out


def _digest(given: str | None, data: bytes, what: str) -> str:
    ours = hashlib.sha256(data).hexdigest()
    if given is not None and given.lower().startswith("sha256:") and given[7:].lower() != ours:
        raise ValueError(f"{what} digest does not match")
    return ours


def parse(data: bytes) -> dict:
    """The fields of one record; raises ValueError where it is not valid."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line")
    field = _fields(lines[1:])
    missing = [f for f in MUST if not field.get(f)]
    if missing:
        raise ValueError(f"without {', '.join(missing)}")
    if not re.fullmatch(r"\d+", field["content-length"]):
        raise ValueError("bad content-length")
    size = int(field["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes where {size} are announced")
    block, kind = rest[:size], field["warc-type"].lower()
    _digest(field.get("warc-block-digest"), block, "block")
    out = {"record_id": field["warc-record-id"], "record_type": kind, "target_uri": field.get("warc-target-uri"), "refers_to": field.get("warc-refers-to"),
           "page_id": field.get("page-id"), "warc_date": field["warc-date"]}
    if kind not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": size, "payload_digest": _digest(field.get("warc-payload-digest"), block, "payload")}
    if not out["target_uri"]:
        raise ValueError("without warc-target-uri")
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    length = _fields(http.split(b"\r\n")[1:]).get("content-length")
    if kind == "response":
        if length is not None and length != str(len(body)):
            raise ValueError("the HTTP head announces another length")
        return out | {"payload": body, "payload_bytes": len(body), "payload_digest": _digest(field.get("warc-payload-digest"), body, "payload")}
    digest = field.get("warc-payload-digest", "").lower()
    if not out["refers_to"] or field.get("warc-profile") != PROFILE or not digest.startswith("sha256:") or not (length or "").isdigit() or body:
        raise ValueError("a revisit that does not say of what")
    return out | {"payload": None, "payload_bytes": int(length), "payload_digest": digest[7:]}


def read_archives(archives: DataFrame, with_payload: bool = True, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The records of all archives named in column ``archive`` (see ``RECORD``)."""
    small_batches(archives.sparkSession)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in pick(batch, "archive").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                size = store.get_file_info(name).size
                with store.open_input_stream(name, compression=None) as source:
                    for a, b, wrong in walk(source, size, span_bytes):
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([wrong], pa.string())], names=["archive", "a", "b", "wrong"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None, None)
        for batch in batches:
            for path, a, b, wrong in zip(*(pick(batch, c).to_pylist() for c in ("archive", "a", "b", "wrong"))):
                if wrong:
                    yield _rows([{"archive": path, "offset": a, "error": wrong}])
                    continue
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    if known[0] != path:
                        known = (path, *_lead(source))
                    data = source.read_at(b - a, a)
                if known[2]:
                    yield _rows([{"archive": path, "offset": a, "error": known[2]}])
                    continue
                at, out, held = 0, [], 0
                while at < len(data):
                    end = frame_end(data, at)
                    row = {"archive": path, "offset": a + at}
                    try:
                        row |= parse(decode(data[at:end], known[1]))
                    except (ValueError, zstandard.ZstdError) as error:  # UnicodeDecodeError is a ValueError
                        row["error"] = str(error)
                    held += len(row.get("payload") or b"")
                    if not with_payload:
                        row.pop("payload", None)
                    out.append(row)
                    at = end
                    if held >= 1 << 20 or len(out) >= 1000:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    wide = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = archives.select("archive").repartition(wide, "archive").mapInArrow(spans, "archive string, a long, b long, wrong string")
    return found.repartition(wide, "archive", "a").mapInArrow(read, RECORD)


_KIND = {"offset": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64()}
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _KIND.get(c, pa.string())) for c in _NAMES], names=_NAMES)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` plus ``original_page``, the page id of the record that a revisit
    refers to. A revisit without that record, or of another length or digest,
    gets an ``error``."""
    target = records.where("record_type = 'response' AND error IS NULL").select(
        F.col("record_id").alias("_wa_target"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("_wa_bytes"), F.col("payload_digest").alias("_wa_digest"))
    out = records.join(target, records["refers_to"] == target["_wa_target"], "left")
    same = F.col("payload_bytes").eqNullSafe(F.col("_wa_bytes")) & F.col("payload_digest").eqNullSafe(F.col("_wa_digest"))
    wrong = (F.col("record_type") == "revisit") & ~same
    return out.withColumn("error", F.coalesce("error", F.when(wrong, F.lit("does not match the record it refers to")))).drop("_wa_target", "_wa_bytes", "_wa_digest")


def digest(pages: DataFrame) -> DataFrame:
    """One row per page, from the archives: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Fails where a record is not valid."""
    kind = pages.schema["page_id"].dataType
    records = materialise(read_archives(write_archives(pages), with_payload=False), "warc-records")
    out = resolve(records)
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("archive", F.lit(" at "), "offset", F.lit(": "), "error")))
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), F.col("original_page").cast(kind).alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest, row_number() OVER () AS place FROM pages
), g AS (
  SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS original FROM p WINDOW w AS (PARTITION BY digest, size ORDER BY page_id NULLS LAST, place)
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN k > 1 AND size >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN k > 1 AND size >= 100 THEN original END AS refers_to
FROM g
"""
