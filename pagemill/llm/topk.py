"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt to blocks of a bounded number of rows. A block keeps, for
every dimension, its list of (component, row) in sorted order. A query reads
every list in sequence from the end that is better for it (the high end where
its own component is positive, the low end where it is negative), a stretch of
each list at a time. What was read of a candidate, and where each list has been
read to, bound its score from below and above. Candidates whose upper bound is
less than the k-th best lower bound are out; reading stops once few are left,
and the final scores of these are resolved from their vectors.

A query meets each block once; blocks return their k best, which are merged.

Defined results: vectors that are null or hold a null or non-finite component
take no part, neither do rows with a null id; only vectors of one length are
compared; ties go to the smaller id, then to the first row; a row is no
candidate for itself, but a row that repeats its id is; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise, with_rid

#: Best scores returned for each query.
K = 10
#: Rows of a candidate block, and of a group of queries that meets a block at once.
BLOCK_ROWS, QUERY_ROWS = 4096, 1 << 16
#: Components are scaled by this and rounded down.
SCALE = 1024
#: Shares of the lists after which bounds are compared.
STOPS = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Reading stops once so few candidates may still qualify.
RESOLVE_ROWS = 256


class Lists:
    """The sorted lists of one block of (rows, dims) integers."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.float64)  # sums of products of scaled components are exact below 2**53
        self.rows = np.argsort(values.T, axis=1, kind="stable")  # (dims, rows), from the low end
        self.sorted = np.take_along_axis(self.values.T, self.rows, axis=1)
        self.unread = np.empty(self.values.shape)  # 1 where a query has not read the component yet

    def best(self, query: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, without ``own``, among which the k best are, and their scores."""
        n, dims = self.values.shape
        part = np.zeros(n)
        self.unread.fill(1.0)
        live = np.ones(n, bool)
        live[own] = False
        down = query >= 0
        worst = np.where(down, self.sorted[:, 0], self.sorted[:, -1]) * query
        up, at = ~down, 0
        for share in STOPS:
            to = min(n, int(np.ceil(share * n)))
            for lists, a, b in ((down, n - to, n - at), (up, at, to)):
                which = np.flatnonzero(lists)
                rows = self.rows[which, a:b]
                self.unread[rows, which[:, None]] = 0.0
                part += np.bincount(rows.ravel(), (self.sorted[which, a:b] * query[which, None]).ravel(), n)
            at = to
            if at < n:
                edge = np.where(down, self.sorted[:, n - at], self.sorted[:, at - 1]) * query
                low, high = (part[:, None] + self.unread @ np.stack([worst, edge], axis=1)).T
                low = np.where(live, low, -np.inf)
                live &= high >= np.partition(low, max(0, n - k))[max(0, n - k)]
            if live.sum() <= max(k, RESOLVE_ROWS):
                break
        rows = np.flatnonzero(live)
        return rows, self.values[rows] @ query


def scaled(vector: Column) -> Column:
    """floor(SCALE * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def top_k(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, id and score of the ``k`` best candidates of every row where ``queries`` holds."""
    ids = with_rid(rows.select(F.col(id_col).alias("_tk_id"), F.col(vector_col).alias("_tk_v"), F.coalesce(queries, F.lit(False)).alias("_tk_q")), "_tk_rid")
    ids = ids.where(F.col("_tk_id").isNotNull() & usable(F.col("_tk_v"))).select("_tk_rid", "_tk_id", "_tk_q", scaled(F.col("_tk_v")).alias("_tk_v"), F.size("_tk_v").alias("_tk_dims"))
    table = materialise(ids, "vectors")

    # blocks and query groups of each vector length, each of a bounded number of rows
    sizes = table.groupBy("_tk_dims").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).alias("_tk_blocks"), F.ceil(F.count_if("_tk_q") / query_rows).alias("_tk_groups"))
    spread = table.join(sizes, "_tk_dims")
    last = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    sides = []
    for mine, n_mine, other, n_other, of in (("_tk_block", "_tk_blocks", "_tk_group", "_tk_groups", spread.where("_tk_groups > 0")), ("_tk_group", "_tk_groups", "_tk_block", "_tk_blocks", spread.where("_tk_q"))):
        sides.append(of.withColumn(mine, F.pmod(F.xxhash64("_tk_rid"), F.col(n_mine)).cast("int")).withColumn(other, F.explode(last(n_other)))
                     .select("_tk_dims", "_tk_block", "_tk_group", "_tk_rid", "_tk_id", "_tk_v"))
    key = ["_tk_dims", "_tk_block", "_tk_group"]

    def meet(key: tuple[pa.Scalar, ...], block: pa.Table, group: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        matrix = lambda v: v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), dims)
        out = {c: [] for c in ("q_rid", "q_id", "id", "rid", "score")}
        if block.num_rows and group.num_rows:
            lists = Lists(matrix(block.column("_tk_v")))
            rid, own_id = block.column("_tk_rid").to_numpy(), block.column("_tk_id").to_numpy()
            for q_rid, q_id, q in zip(group.column("q_tk_rid").to_pylist(), group.column("q_tk_id").to_pylist(), matrix(group.column("q_tk_v")).astype(np.float64)):
                at, score = lists.best(q, k, rid == q_rid) if dims else (np.flatnonzero(rid != q_rid), np.zeros((rid != q_rid).sum()))
                at, score = (x[np.lexsort((rid[at], own_id[at], -score))[:k]] for x in (at, score))
                out["q_rid"] += [q_rid] * len(at)
                out["q_id"] += [q_id] * len(at)
                out["id"] += own_id[at].tolist()
                out["rid"] += rid[at].tolist()
                out["score"] += score.astype(np.int64).tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    side = sides[1].select(*[F.col(c).alias(f"q{c}") for c in sides[1].columns])
    best = sides[0].groupBy(*key).cogroup(side.groupBy(*[f"q{c}" for c in key])).applyInArrow(meet, "q_rid long, q_id long, id long, rid long, score long")
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), "id", "rid")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by 100."""
    return top_k(embeddings, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.w) = len(c.w)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
