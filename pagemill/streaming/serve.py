"""Serve presets on arriving pages with Structured Streaming, and generate
presets for hosts that have none.

``readStream`` of page files with a fixed schema; each micro-batch is
parsed, matched to its host's presets (P11), extracted with the chosen
preset (P9) and rendered (M14). Pages without a matching preset wait.

With ``enough`` given, waiting pages become presets. A small state, one row for
each host with waiting pages, is folded from batch to batch: how many wait, how
many waited when presets were last mined, and since which batch. A host with
``enough`` waiting pages, and twice as many as last time, is due: its waiting
pages are mined (I2-I6), accepted presets become a new version of the preset
table, the waiting pages that they match are extracted in the same batch, and
later pages of the host are served by them.

A batch writes only its own folders (``extracts``, ``queue``, ``presets``,
``resolved`` and ``hosts``, each by ``batch_id``) and reads only those of earlier
ones, so a batch that is replayed after a failure rewrites the same output.
What a batch made on its way is removed at its end. A state of a host is one row
whatever its pages; a hot host is due as soon as it has ``enough``, and is mined
by aggregates, never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import url_host
from pagemill.operators import induce as I
from pagemill.operators import presets as P
from pagemill.operators.clean import clean_nodes
from pagemill.operators.markdown import render
from pagemill.operators.nodes import node_table
from pagemill.session import cut, delete, exists, scratch
from pagemill.sources.pages import PAGES_SCHEMA, PRESETS_TABLE_SCHEMA

#: Generated presets come after those that were given.
GENERATED_PRIORITY = 1 << 20
HOSTS_SCHEMA = "host string, waiting long, tried long, since long"


def extract_batch(pages: DataFrame, presets: DataFrame, compiled: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch form of the serving step: ``(extracts, queue)``."""
    pairs = cut(P.page_presets(pages, presets))
    known = pages.join(pairs.select("page_id").distinct(), "page_id", "left_semi").select(*pages.columns)
    nodes = node_table(known)  # a page of a host without presets waits unparsed
    run = P.run_presets(nodes, known, presets, pairs, compiled)
    chosen, queue = P.choose_preset(run, pages)
    res, doc = P.apply_presets(P.only_pairs(run, chosen), nodes)
    md = render(doc, keys=("page_id", "preset_id"))
    ext = (chosen.join(res, ["page_id", "preset_id"]).join(md, ["page_id", "preset_id"], "left")
           .join(pages.select("page_id", "url"), "page_id")
           .select("page_id", "url", "preset_id", "status", F.coalesce("markdown", F.lit("")).alias("markdown")))
    return ext, pages.select("page_id", "url").join(queue, "page_id", "left_semi")


class Store:
    """The folders of a stream's output, one below each for every batch."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir = spark, out_dir

    def put(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.out_dir}/{name}/batch_id={batch_id}")

    def one(self, name: str, batch_id: int, schema) -> DataFrame:
        """What one batch wrote (nothing, if it wrote nothing)."""
        path = f"{self.out_dir}/{name}/batch_id={batch_id}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def before(self, name: str, batch_id: int, schema: str, since: int = 0) -> DataFrame:
        """What batches wrote from ``since`` on and before ``batch_id``; other folders are not read."""
        if not exists(self.spark, f"{self.out_dir}/{name}"):
            return self.spark.createDataFrame([], f"{schema}, batch_id long")
        rows = self.spark.read.schema(f"{schema}, batch_id long").parquet(f"{self.out_dir}/{name}")
        return rows.where((F.col("batch_id") >= since) & (F.col("batch_id") < batch_id))


_PRESETS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PRESETS_TABLE_SCHEMA.fields)
_PAGES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAGES_SCHEMA.fields)


def known_presets(store: Store, given: DataFrame | None, batch_id: int) -> DataFrame:
    """The given presets and the latest version of every generated one, as a batch sees them."""
    made = store.before("presets", batch_id, _PRESETS)
    body = F.struct(*[f.name for f in PRESETS_TABLE_SCHEMA.fields])
    latest = made.groupBy("host", "preset_id").agg(F.max_by(body, "batch_id").alias("p")).select("p.*")
    return latest if given is None else given.select(latest.columns).unionByName(latest)


def fold_hosts(before: DataFrame, arrived: DataFrame, batch_id: int, enough: int) -> DataFrame:
    """The hosts' state with the pages that wait since this batch, and which are ``due``."""
    new = arrived.where("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("new"))
    both = before.join(new, "host", "full").select(
        "host", (F.coalesce("waiting", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("waiting"),
        F.coalesce("tried", F.lit(0)).cast("long").alias("tried"), F.coalesce("since", F.lit(batch_id)).cast("long").alias("since"))
    return both.withColumn("due", F.col("waiting") >= F.greatest(F.lit(enough), 2 * F.col("tried")))


def generate(store: Store, arrived: DataFrame, batch_id: int, enough: int, max_rounds: int) -> DataFrame | None:
    """The "else generate" half: folds the state, mines presets for the hosts that
    are due and returns what these extract from their waiting pages (None: no host is due).

    ``arrived`` has page_id, url, html and host of the pages that wait since this batch.
    """
    state = cut(fold_hosts(store.one("hosts", batch_id - 1, HOSTS_SCHEMA), arrived, batch_id, enough))
    due = state.where("due").select("host")
    since = state.where("due").agg(F.min("since")).first()[0]  # one number
    if since is None:
        store.put(state.drop("due"), "hosts", batch_id)
        return None
    earlier = store.before("queue", batch_id, _PAGES, since).drop("batch_id")
    earlier = earlier.join(store.before("resolved", batch_id, "page_id long", since), "page_id", "left_anti").withColumn("host", url_host("url"))
    pages = cut(earlier.select(arrived.columns).unionByName(arrived).join(due, "host", "left_semi"))
    waiting = pages.select("page_id", "url", "html")
    final = I.final_presets(I.induce(clean_nodes(waiting), waiting, max_rounds)).where("accepted")
    presets = cut(final.withColumn("priority", F.col("priority") + GENERATED_PRIORITY).select([f.name for f in PRESETS_TABLE_SCHEMA.fields]))
    extracts, still = extract_batch(waiting, presets)
    extracts = cut(extracts)
    store.put(presets, "presets", batch_id)
    store.put(extracts.select("page_id"), "resolved", batch_id)
    left = pages.join(still.select("page_id"), "page_id", "left_semi").groupBy("host").agg(F.count(F.lit(1)).alias("left"))
    after = state.join(left, "host", "left").select(
        "host", F.when(F.col("due"), F.coalesce("left", F.lit(0))).otherwise(F.col("waiting")).alias("waiting"),
        F.when(F.col("due"), F.coalesce("left", F.lit(0))).otherwise(F.col("tried")).alias("tried"), "since")
    store.put(after.where("waiting > 0"), "hosts", batch_id)
    return extracts


def serve(spark: SparkSession, source: str, presets: DataFrame | None, out_dir: str, checkpoint: str,
          glob: str = "*.parquet", available_now: bool = True, files_per_batch: int = 64,
          enough: int | None = None, max_rounds: int = I.MAX_ROUNDS):
    """Start the stream; returns the ``StreamingQuery``. ``files_per_batch``
    only paces the micro-batches; every file is served. Without ``enough``
    pages only wait."""
    stream = (spark.readStream.schema(PAGES_SCHEMA).option("pathGlobFilter", glob)
              .option("maxFilesPerTrigger", files_per_batch).parquet(source))
    held: dict = {}  # presets and their compiled selectors, until there is a new version

    def handle(batch: DataFrame, batch_id: int):
        own = batch.sparkSession
        store = Store(own, out_dir)
        if not held or held["stale"] or held["next"] != batch_id:
            known = cut(known_presets(store, presets, batch_id)) if enough else presets
            held.update(known=known, compiled=P.compile_presets(known))
        held.update(next=batch_id + 1, stale=False)
        with scratch(own):
            pages = cut(batch)  # read several times below
            extracts, queue = extract_batch(pages, held["known"], held["compiled"])
            arrived = cut(pages.join(queue.select("page_id"), "page_id", "left_semi").withColumn("host", url_host("url")))
            if enough:
                made = generate(store, arrived, batch_id, enough, max_rounds)
                if made is not None:
                    extracts = extracts.unionByName(made)
                    held["stale"] = True
            store.put(arrived.select("page_id", "url", "html"), "queue", batch_id)
            store.put(extracts, "extracts", batch_id)
        if enough and batch_id > 1:  # only the state of the batch before is read again
            delete(own, f"{out_dir}/hosts/batch_id={batch_id - 2}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
