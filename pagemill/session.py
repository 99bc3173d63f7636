"""SparkSession construction and cluster-safe settings."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


#: Set where the submitted configuration does not say otherwise.
DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "pagemill", shuffle_partitions: int | None = None) -> SparkSession:
    """The session; what was submitted wins over the defaults here.

    Only where no master is given or submitted, a local session is built, with
    few shuffle partitions and a driver that holds all executors' memory. AQE
    coalesces partitions and splits skewed joins at run time. The Arrow batch
    size is small because one page expands to hundreds of node rows.
    """
    submitted = dict(SparkConf().getAll())
    conf = {k: v for k, v in DEFAULTS.items() if k not in submitted}
    builder = SparkSession.builder.appName(app)
    if master or "spark.master" not in submitted:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        conf |= {"spark.driver.memory": submitted.get("spark.driver.memory", "16g"), "spark.sql.shuffle.partitions": str(shuffle_partitions or 8)}
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    checkpoint_dir(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, so that they can import it wherever
    the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_pagemill_shipped", False):
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="pagemill-ship-"), "pagemill"), "zip", root, "pagemill")
    sc.addPyFile(path)
    sc._pagemill_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local runs
    and tests) do we create a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not path:
        path = tempfile.mkdtemp(prefix="pagemill-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut(df):
    """Materialise ``df`` into the shared checkpoint folder and return a
    DataFrame that reads it back: ends lineage (plan size, recovery after a
    lost executor) for iterative and reused intermediate results. Within
    ``scratch`` it is a Parquet folder, which goes when that ends."""
    held = _scratch.get()
    if held is None or any(f.dataType.typeName() == "void" for f in df.schema.fields):
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    import uuid

    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/cut_{uuid.uuid4().hex}"
    held.append((None, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the bucketed tables that one bucket should hold, about. A task sorts its
#: bucket once for every window in a row, so it holds this several times.
BUCKET_BYTES = 24 << 20
#: A page's node rows take about this many times its table's bytes.
NODE_FACTOR = 8
_BUCKETS = "spark.pagemill.buckets"
_SUBSET = "spark.sql.requireAllClusterKeysForCoPartition"
#: Tables and folders made within ``scratch``; each thread has its own, as a session's streams run side by side.
_scratch: contextvars.ContextVar[list[tuple[str | None, str]] | None] = contextvars.ContextVar("scratch", default=None)


def plan_buckets(pages) -> None:
    """Fixes the number of buckets of this session's tables from the size of a page table.

    Tables that are joined must agree in it, so it only grows: at least the
    shuffle partitions, more where the pages' nodes would overfill a bucket.
    Joins on the page and more keep the buckets, in whatever session they run.
    """
    spark = pages.sparkSession
    if _SUBSET not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(_SUBSET, "false")
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:  # else unknown, as for a checkpoint
        now = buckets_of(spark)
        spark.conf.set(_BUCKETS, str(max(now, min(100_000, -(-size * NODE_FACTOR // BUCKET_BYTES)))))


def buckets_of(spark: SparkSession) -> int:
    """The number of buckets of this session's tables."""
    return int(spark.conf.get(_BUCKETS, spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df, key: str, prefix: str = "pagemill", buckets: int | None = None):
    """Write ``df`` bucketed by ``key`` into the shared checkpoint folder and
    read it back as a table, in whatever catalog the session has.

    Reads of a bucketed table are hash-partitioned on ``key``, so later
    joins, windows and aggregations keyed by it need no exchange (a plain
    checkpoint loses that). Rows are first repartitioned into exactly
    ``buckets`` partitions on ``key`` with the same hash, so each task writes
    one bucket file.
    """
    import uuid

    spark = df.sparkSession
    n = buckets or buckets_of(spark)
    name = f"{prefix}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(name)
    held = _scratch.get()
    if held is not None:
        held.append((name, path))
    return spark.table(name)


def merged(df):
    """``df``, which grows with the pages, marked to be joined by merging.

    The planner goes by the bytes of a bucketed table's files, in which repeated
    values take next to nothing, and would collect such a table in the driver to
    broadcast it, though a join on the page needs no exchange. The mark holds up
    to the next join.
    """
    return df.hint("merge")


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Drops the tables and cuts made inside, with their files, at the end: for
    work whose results are written before it ends, as a micro-batch's. The
    number of buckets is that of this work, not of an earlier, larger one."""
    token = _scratch.set([])
    buckets = spark.conf.get(_BUCKETS, None)
    spark.conf.unset(_BUCKETS)
    try:
        yield
    finally:
        made = _scratch.get()
        _scratch.reset(token)
        if buckets is None:
            spark.conf.unset(_BUCKETS)
        else:
            spark.conf.set(_BUCKETS, buckets)
        for name, path in made:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS `{name}`")
            delete(spark, path)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _folder(spark, path)
    return store.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    store, where = _folder(spark, path)
    store.delete(where, True)
