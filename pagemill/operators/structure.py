"""Structural predicates on the interval-encoded node table.

Subtrees are either nested or disjoint, which turns the usual containment
joins into running aggregates over one page in document order:

* ``inside_marked``: n lies in (or is) the subtree of a marked node iff the
  running max of ``pre_end`` over marked nodes with ``pre <= n.pre`` reaches
  ``n.pre``.
* ``subtree_has``: the subtree of n holds a marked node iff the first marked
  ``pre`` at or after ``n.pre`` is ``<= n.pre_end`` (running min in reverse
  document order).

Each is one window partitioned by page, linear in the page's nodes, and a
page is the unit of skew (bounded by its html size), never a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(key_cols):
    return [key_cols] if isinstance(key_cols, str) else list(key_cols)


def inside_marked(mark: Column, key_cols=("page_id",), strict: bool = False) -> Column:
    """True when the node is a marked node or lies inside one.

    With ``strict`` the node itself does not count (proper descendants only).
    """
    w = Window.partitionBy(*_keys(key_cols)).orderBy("pre").rowsBetween(Window.unboundedPreceding,
                                                                         -1 if strict else Window.currentRow)
    reach = F.max(F.when(mark, F.col("pre_end"))).over(w)
    return F.coalesce(reach >= F.col("pre"), F.lit(False))


def subtree_has(mark: Column, key_cols=("page_id",), strict: bool = False) -> Column:
    """True when the node's subtree (self included unless ``strict``) holds a marked node."""
    w = Window.partitionBy(*_keys(key_cols)).orderBy(F.col("pre").desc()).rowsBetween(
        Window.unboundedPreceding, -1 if strict else Window.currentRow)
    first = F.min(F.when(mark, F.col("pre"))).over(w)
    return F.coalesce(first <= F.col("pre_end"), F.lit(False))


def open_count(nodes: DataFrame, mark: Column, out: str, key_cols=("page_id",), strict: bool = False) -> DataFrame:
    """Adds ``out`` = number of marked ancestors (self included unless ``strict``).

    Each marked node contributes +1 at its start and -1 just after its last
    descendant; a running sum in document order counts the open ones. One
    union and one window, linear in the page's nodes.
    """
    keys = _keys(key_cols)
    base = nodes.withColumn("_m", F.coalesce(mark, F.lit(False)))
    nodes_ev = base.withColumn("_pos", F.col("pre").cast("double")).withColumn(
        "_d", F.when(F.col("_m"), 1).otherwise(0)).withColumn("_node", F.lit(True))
    closes = base.where("_m").select(
        *keys, (F.col("pre_end") + F.lit(0.5)).alias("_pos"), F.lit(-1).alias("_d"), F.lit(False).alias("_node"))
    ev = nodes_ev.unionByName(closes, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn(out, F.sum("_d").over(w).cast("int"))
    if strict:
        ev = ev.withColumn(out, F.col(out) - F.when(F.col("_m"), 1).otherwise(0))
    return ev.where("_node").drop("_pos", "_d", "_node", "_m")


def remove_subtrees(nodes: DataFrame, root_mark: Column, key_cols=("page_id",)) -> DataFrame:
    """Left-anti containment join in closed form: drop marked subtrees."""
    return nodes.withColumn("_in", inside_marked(root_mark, key_cols)).where(~F.col("_in")).drop("_in")


def element_children_count(key_cols=("page_id",)) -> Column:
    w = Window.partitionBy(*_keys(key_cols), "parent")
    return F.count(F.lit(1)).over(w)


def tighten_ends(nodes: DataFrame, key_cols=("page_id",)) -> DataFrame:
    """Recompute ``pre_end`` as the last *remaining* node of each subtree
    after nodes were removed: a probe event at ``pre_end + 0.5`` (emitted by
    ``explode`` from the node's own row, so no exchange) reads the running
    max of ``pre`` in document order."""
    keys = _keys(key_cols)
    narrow = nodes.select(*keys, "pre", "pre_end")
    e = narrow.withColumn("_e", F.explode(F.array(
        F.struct(F.col("pre").cast("double").alias("_pos"), F.lit(False).alias("_probe")),
        F.struct((F.col("pre_end") + F.lit(0.5)).alias("_pos"), F.lit(True).alias("_probe")))))
    w = Window.partitionBy(*keys).orderBy(F.col("_e._pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.withColumn("_last", F.max(F.when(~F.col("_e._probe"), F.col("pre"))).over(w))
    ends = e.where(F.col("_e._probe")).select(*keys, "pre", F.col("_last").alias("_new_end"))
    return (nodes.join(ends, [*keys, "pre"], "left")
            .withColumn("pre_end", F.coalesce(F.greatest(F.col("_new_end"), F.col("pre")), F.col("pre")))
            .drop("_new_end"))


def open_counts(nodes: DataFrame, marks: dict, key_cols=("page_id",)) -> DataFrame:
    """Several ``open_count`` columns in one window pass.

    ``marks`` maps an output column to ``(mark Column, strict)``; each output
    is the number of marked ancestors (self included unless strict). A
    marked node also emits a closing event at ``pre_end + 0.5`` with
    ``explode`` on its own row (not a union), so the page partitioning of
    the input is kept and the window needs no exchange.
    """
    keys = _keys(key_cols)
    names = list(marks)
    base = nodes
    for i, name in enumerate(names):
        base = base.withColumn(f"_m{i}", F.coalesce(marks[name][0], F.lit(False)))
    any_mark = F.lit(False)
    for i in range(len(names)):
        any_mark = any_mark | F.col(f"_m{i}")

    def ev(pos, node, sign):
        return F.struct(pos.alias("_pos"), F.lit(node).alias("_node"),
                        *[(F.when(F.col(f"_m{i}"), sign).otherwise(0)).alias(f"_d{i}") for i in range(len(names))])

    opened = ev(F.col("pre").cast("double"), True, 1)
    closed = ev(F.col("pre_end") + F.lit(0.5), False, -1)
    e = base.withColumn("_e", F.explode(F.when(any_mark, F.array(opened, closed)).otherwise(F.array(opened))))
    w = Window.partitionBy(*keys).orderBy(F.col("_e._pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = {}
    for i, name in enumerate(names):
        cnt = F.sum(F.col(f"_e._d{i}")).over(w).cast("int")
        if marks[name][1]:
            cnt = cnt - F.when(F.col(f"_m{i}"), 1).otherwise(0)
        counts[name] = cnt
    e = e.withColumns(counts)  # at once: added one by one, each is a window of its own that sorts all rows again
    return e.where(F.col("_e._node")).drop("_e", *[f"_m{i}" for i in range(len(names))])


def subtree_sums(nodes: DataFrame, measures: dict, key_cols=("page_id",)) -> DataFrame:
    """(keys..., pre, one column per measure): of every element the sums over its
    subtree, itself included, of a whole number that each node has.

    An element's own row emits events before and behind its subtree; the
    running sums at both differ by the subtree's. One window, no exchange on
    a table that is partitioned by the keys.
    """
    keys, names = _keys(key_cols), list(measures)
    zero = [F.lit(0).cast("long").alias(c) for c in names]

    def event(pos, side, values):
        return F.struct(pos.cast("double").alias("_pos"), F.lit(side).alias("_side"), *values)

    own = event(F.col("pre"), 0, [F.coalesce(measures[c], F.lit(0)).cast("long").alias(c) for c in names])
    ends = [event(F.col("pre") - F.lit(0.5), 1, zero), event(F.col("pre_end") + F.lit(0.5), 2, zero)]
    e = nodes.select(*keys, "pre", F.explode(F.when(F.col("kind") == "element", F.array(ends[0], own, ends[1])).otherwise(F.array(own))).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_e._pos").rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*keys, "pre", "_e._side", *[F.sum(f"_e.{c}").over(w).alias(c) for c in names]).where("_side > 0")
    at = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    return e.groupBy(*keys, "pre").agg(*[(at(2, c) - at(1, c)).alias(c) for c in names])


def open_sums(nodes: DataFrame, measures: dict, key_cols=("page_id",)) -> DataFrame:
    """``nodes`` plus one column per measure: the sum over a node's ancestors and
    itself of a whole number that each element has.

    An element's own row gives its value before its subtree and takes it back
    behind; a running sum in document order holds what is open. One window.
    """
    keys, names = _keys(key_cols), list(measures)
    is_el = F.col("kind") == "element"

    def event(pos, node, sign):
        return F.struct(pos.cast("double").alias("_pos"), F.lit(node).alias("_node"),
                        *[(F.when(is_el, measures[c]).otherwise(0).cast("long") * F.lit(sign)).alias(c) for c in names])

    both = F.array(event(F.col("pre"), True, 1), event(F.col("pre_end") + F.lit(0.5), False, -1))
    e = nodes.withColumn("_e", F.explode(F.when(is_el, both).otherwise(F.slice(both, 1, 1))))
    # of elements that end together the order does not matter: all of them are closed before the next node
    w = Window.partitionBy(*keys).orderBy("_e._pos").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(*nodes.columns, "_e._node", *[F.sum(f"_e.{c}").over(w).alias(c) for c in names]).where("_node").drop("_node")
