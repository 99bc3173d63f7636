"""WARC archives: round trips, validation of broken ones, revisits against brute force."""
from __future__ import annotations

import hashlib
import io
import struct
from collections import Counter

import pytest
import zstandard

from pagemill.llm import warc

from .conftest import prose

SCHEMA = "page_id long, url string, html string"
CLASH = {"archive": "1", "offset": "2", "record_id": "3", "record_type": "4", "error": "5", "refers_to": "6", "n": "7", "first": "8"}


def pages():
    out = [(i, f"http://h{i % 3}.example/p/{i}", f"<p>{prose(60, i)}</p>") for i in range(60)]
    out += [(i, "http://copy.example/", out[5][2]) for i in (70, 4, 71, 3)]  # copies: the least id is the response
    out += [(72, None, None), (73, "", ""), (74, "http://e.example/a b\r\nX: y\x00é", "x" * 99), (75, "u", "x" * 99), (76, "u", "x" * 100), (77, "u", "x" * 100), (77, "u", "x" * 100)]
    out += [(None, "n", "y" * 200), (78, "n", "y" * 200), (None, "n", "z" * 200), (None, "n", "z" * 200), (79, "l", "é日" * 300_000), (80, "b", "WARC/1.1\r\n\r\n\r\n\r\n" * 9)]
    return out


def brute(rows):
    out = []
    for k, (i, _, html) in enumerate(rows):
        body = (html or "").encode()
        first = min((r[0] is None, r[0] or 0, j) for j, r in enumerate(rows) if (r[2] or "") == (html or ""))
        again = len(body) >= 100 and first[2] != k
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", (None if first[0] else first[1]) if again else None))
    return Counter(out)


def test_digest_equals_brute_force(table):
    assert Counter(tuple(r) for r in warc.digest(table(pages(), SCHEMA, extra=CLASH)).collect()) == brute(pages())


def test_sql_says_the_same(table):
    import duckdb

    con = duckdb.connect()
    docs = table(pages(), SCHEMA, 1)
    con.register("pages", docs.toArrow())
    assert Counter(con.sql(warc.ORACLE_SQL).fetchall()) == Counter(tuple(r) for r in warc.digest(docs).collect())


def test_payloads_come_back_through_dictionaries_and_small_archives(table, monkeypatch):
    rows = [(i, "u", f"<html><body class='page'><p>{prose(90, i)}</p></body></html>") for i in range(400)]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    made = warc.write_archives(table(rows, SCHEMA, 2))
    files = made.collect()
    assert len(files) > 4 and sum(f.records for f in files) == 400
    for f in files:
        data = open(f.archive.removeprefix("file:").replace("///", "/").replace("//", "/"), "rb").read()
        assert struct.unpack("<I", data[:4])[0] == warc.DICT_FRAME and len(data) == f.bytes
    got = warc.read_archives(made, span_bytes=3_000).collect()
    assert {int(r.page_id): bytes(r.payload).decode() for r in got} == {i: html for i, _, html in rows} and not any(r.error for r in got)
    assert len({(r.archive, r.offset) for r in got}) == 400


def test_empty_table(table):
    assert warc.digest(table([], SCHEMA, 1)).collect() == []


def archive(tmp_path, frames, lead=b"", tail=b""):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(lead + b"".join(frames) + tail)
    return f"file://{path}"


def read(spark, *paths, **how):
    return sorted(warc.read_archives(spark.createDataFrame([(p,) for p in paths], "archive string"), **how).collect(), key=lambda r: (r.archive, r.offset))


GOOD = warc.record("<urn:uuid:1>", 1, "http://a/", b"<p>hi</p>")


def squeeze(data, **how):
    return zstandard.ZstdCompressor(**how).compress(data)


@pytest.mark.parametrize("data,what", [
    (GOOD.replace(b"WARC/1.1", b"WARC/9", 1), "version"), (GOOD[:-2], "announced"), (GOOD + b"x", "announced"), (GOOD.replace(b"hi", b"ho"), "block digest"),
    (GOOD.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), "warc-date"), (GOOD.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: revisit"), "more than once"),
    (GOOD.replace(b"WARC-Target-URI: http://a/\r\n", b""), "warc-target-uri"), (GOOD.replace(b"Page-Id", b"Page Id "), "bad header"),
    (GOOD.replace(b"Content-Length: 9", b"Content-Length: 8"), "block digest"), (b"", "version"), (GOOD + GOOD, "announced"), (GOOD.replace(b"http://a/", b"http://\xff/"), "utf-8"),
])
def test_what_is_wrong_with_one_record_is_told_and_the_others_are_read(spark, tmp_path, data, what):
    rows = read(spark, archive(tmp_path, [squeeze(GOOD), squeeze(data), squeeze(GOOD)]))
    assert [r.error is None for r in rows] == [True, False, True] and what in rows[1].error
    assert rows[2].payload == b"<p>hi</p>" and rows[2].page_id == "1"


def test_frames_of_all_kinds(spark, tmp_path):
    long = warc.record("<urn:uuid:2>", 2, "http://b/", bytes(range(256)) * 2000)
    zeros = warc.record("<urn:uuid:3>", 3, "http://c/", b"\0" * 700_000)  # blocks of one repeated byte
    bare = zstandard.ZstdCompressor(level=1, write_content_size=False).compressobj()
    frames = [squeeze(GOOD), squeeze(long, write_checksum=True), b"\x53\x2a\x4d\x18\x03\x00\x00\x00abc", squeeze(zeros), bare.compress(long) + bare.flush(), squeeze(GOOD, write_content_size=False)]
    for size in (1, 1 << 20):
        rows = read(spark, archive(tmp_path, frames), span_bytes=size)
        assert [r.page_id for r in rows] == ["1", "2", "3", "2", "1"] and not any(r.error for r in rows)
        assert rows[2].payload == b"\0" * 700_000


def test_dictionaries_compressed_plain_missing_and_false(spark, tmp_path):
    samples = [warc.record(f"<urn:uuid:{i}>", i, "http://a/", prose(80, i).encode()) for i in range(300)]
    trained = zstandard.train_dictionary(8192, samples)
    frames = [zstandard.ZstdCompressor(dict_data=trained).compress(s) for s in samples]
    skip = lambda body: struct.pack("<II", warc.DICT_FRAME, len(body)) + body
    for lead in (skip(trained.as_bytes()), skip(squeeze(trained.as_bytes()))):
        rows = read(spark, archive(tmp_path, frames, lead), span_bytes=5_000)
        assert [r.page_id for r in rows] == [str(i) for i in range(300)] and not any(r.error for r in rows)
    assert all(r.error for r in read(spark, archive(tmp_path, frames)))
    rows = read(spark, archive(tmp_path, frames, skip(b"no dictionary")))
    assert rows and all("dictionary" in r.error for r in rows)


@pytest.mark.parametrize("tail,what", [(squeeze(GOOD)[:-5], "within a frame"), (b"PK\x03\x04 and more", "no frame"), (b"\x28\xb5", "within a frame"), (b"\x28\xb5\x2f\xfd\x00", "within a frame")])
def test_archives_that_end_badly(spark, tmp_path, tail, what):
    rows = read(spark, archive(tmp_path, [squeeze(GOOD)] * 3, tail=tail))
    assert [r.error is None for r in rows] == [True, True, True, False] and what in rows[-1].error


def test_revisits_of_nothing_and_of_something_else(spark, tmp_path):
    body = b"<p>" + b"x" * 200
    rows = [warc.record("<urn:uuid:1>", 1, "u", body), warc.record("<urn:uuid:2>", 2, "u", body, "<urn:uuid:1>"), warc.record("<urn:uuid:3>", 3, "u", body, "<urn:uuid:9>"), warc.record("<urn:uuid:4>", 4, "u", body + b"y", "<urn:uuid:1>")]
    got = warc.resolve(warc.read_archives(spark.createDataFrame([(archive(tmp_path, [squeeze(r) for r in rows]),)], "archive string"))).collect()
    assert {r.page_id: (r.original_page, r.error is None) for r in got} == {"1": (None, True), "2": ("1", True), "3": (None, False), "4": ("1", False)}


def test_walk_reads_in_pieces():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 5))

    data = b"".join(squeeze(GOOD + bytes([k])) for k in range(9))
    assert [x for x in warc.walk(Slow(data), len(data), 1 << 20)] == [(0, len(data), None)]
