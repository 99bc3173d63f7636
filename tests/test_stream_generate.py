"""The stream that makes presets for hosts without any, and what it leaves behind."""
from __future__ import annotations

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from pagemill.session import checkpoint_dir, cut, scratch
from pagemill.streaming import serve as S


def page(host: str, i: int, layout: str = "article"):
    text = f"<p>story {i} " + f"word{i} " * 60 + f"</p><p>more words {i}</p>"
    box = f"<article><h1>Title {i}</h1>{text}</article>" if layout == "article" else f"<div class='post'><h1>Title {i}</h1>{text}</div>"
    return (i, f"https://{host}/{i}", f"<html><body><nav><a href='/'>home</a></nav>{box}<footer>end</footer></body></html>")


#: Batches: a new host gets its third page in the second; another never has three; a third changes its layout.
BATCHES = [
    [page("new.example.com", 0), page("new.example.com", 1), page("few.example.com", 100)],
    [page("new.example.com", 2), page("few.example.com", 101)],
    [page("new.example.com", 3), page("new.example.com", 4), (200, "not a url", "<p>x</p>")],
]


def left(spark) -> int:
    path = checkpoint_dir(spark).removeprefix("file:")
    return sum(len(files) for _, _, files in os.walk(path))


@pytest.fixture(scope="module")
def streamed(spark):
    base = tempfile.mkdtemp(prefix="generate-", dir="/tmp")
    for rows in BATCHES:
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    S.serve(spark, f"{base}/in", None, f"{base}/out", f"{base}/ckpt", files_per_batch=1, enough=3).awaitTermination()
    return base


def rows_of(spark, base, name):
    return sorted(tuple(r) for r in spark.read.parquet(f"{base}/out/{name}").collect())


def test_later_pages_are_served_by_a_preset_mined_from_earlier_ones(spark, streamed):
    done = spark.read.parquet(f"{streamed}/out/extracts")
    assert {r.page_id: r.batch_id for r in done.collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}
    for r in done.collect():
        assert r.status == "ok" and r.markdown.startswith(f"# Title {r.page_id}\n") and "home" not in r.markdown and "end" not in r.markdown
    made = spark.read.parquet(f"{streamed}/out/presets").collect()
    assert [(r.host, r.batch_id, r.main_content_selectors) for r in made] == [("new.example.com", 1, ["article"])]
    assert {r.preset_id for r in done.collect()} == {made[0].preset_id}
    assert {(r.page_id, r.batch_id) for r in spark.read.parquet(f"{streamed}/out/queue").collect()} == {(0, 0), (1, 0), (100, 0), (2, 1), (101, 1), (200, 2)}


def test_the_state_is_one_row_for_each_host_that_waits(spark, streamed):
    assert sorted(os.listdir(f"{streamed}/out/hosts")) == ["batch_id=1", "batch_id=2"]
    assert rows_of(spark, streamed, "hosts") == [("few.example.com", 2, 0, 0, 1), ("few.example.com", 2, 0, 0, 2)]


def test_a_replayed_batch_changes_nothing(spark, streamed):
    names = ["extracts", "presets", "resolved", "queue"]
    before = {n: rows_of(spark, streamed, n) for n in names}
    store = S.Store(spark, f"{streamed}/out")
    with scratch(spark):  # the second batch again, its state and later folders being there
        store.put(spark.createDataFrame([("new.example.com", 2, 0, 0), ("few.example.com", 1, 0, 0)], S.HOSTS_SCHEMA), "hosts", 0)
        batch = spark.createDataFrame(BATCHES[1], "page_id long, url string, html string")
        known = S.known_presets(store, None, 1)
        assert known.count() == 0
        extracts, queue = S.extract_batch(batch, known)
        arrived = cut(batch.join(queue.select("page_id"), "page_id", "left_semi").withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)))
        store.put(S.generate(store, arrived, 1, 3, 5), "extracts", 1)
    assert {n: rows_of(spark, streamed, n) for n in names} == before


def test_nothing_is_left_behind(spark):
    base = tempfile.mkdtemp(prefix="left-", dir="/tmp")
    for k in range(3):
        spark.createDataFrame([page("new.example.com", 10 * k + i) for i in range(2)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.createDataFrame([page("new.example.com", 0)], "page_id long, url string, html string").count()
    before = left(spark)
    tables = len(spark.catalog.listTables())
    S.serve(spark, f"{base}/in", None, f"{base}/out", f"{base}/ckpt", files_per_batch=1, enough=3).awaitTermination()
    versions = len(os.listdir(f"{base}/out/presets")) + 1  # of each version the presets and their selectors stay
    assert len(spark.catalog.listTables()) == tables
    assert left(spark) - before <= versions * 2 * 2 * (spark.sparkContext.defaultParallelism + 8)
    assert not [d for _, dirs, _ in os.walk(checkpoint_dir(spark).removeprefix("file:")) for d in dirs if d.startswith("cut_")]


def test_a_host_is_tried_again_only_when_twice_as_many_wait(spark):
    state = spark.createDataFrame([("a", 3, 3, 0), ("b", 5, 3, 0)], S.HOSTS_SCHEMA)
    arrived = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "host string")
    got = {r.host: (r.waiting, r.tried, r.since, r.due) for r in S.fold_hosts(state, arrived, 7, 3).collect()}
    assert got == {"a": (4, 3, 0, False), "b": (6, 3, 0, True), "c": (1, 0, 7, False)}


def test_scratch_of_one_thread_is_not_that_of_another(spark):
    seen, ready, done = {}, threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            seen["path"] = cut(spark.range(3)).inputFiles()[0]
            ready.set()
            done.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with scratch(spark):
        cut(spark.range(2))
    assert os.path.exists(seen["path"].removeprefix("file://").removeprefix("file:"))
    done.set()
    thread.join()
    assert not os.path.exists(seen["path"].removeprefix("file://").removeprefix("file:"))
