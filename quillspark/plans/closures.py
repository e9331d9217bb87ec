"""Closures over edge tables: what roots lead to, and the layers of a graph of steps.

A node with one parent is as far from anywhere as its parent, and one step more. So all nodes of one parent are first hung
on the nearest node above that has none or several, by pointer doubling: each round doubles the way a pointer spans, so a
chain of n nodes takes log n rounds. What is left is a graph of the nodes with several parents alone, with edges as long
as the ways they stand for; it is empty for trees and chains. Over it, depths are relaxed or layers peeled, a round for
each such node on the longest way. Each round starts from a table of the one before, and only its frontier is joined.

Pointers that never arrive, because they go around a cycle, are told by their span: it exceeds the number of nodes.
Null ends are no edges, and repeated edges are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, table


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct()


def anchors(edges: DataFrame, stops: DataFrame) -> DataFrame:
    """(node, anchor, hops): for every child with one parent that isn't among stops (node), the nearest node above it that is
    a stop or has no or several parents. Children on or below a cycle of such nodes have none and are left out."""
    single = edges.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"), F.count("*").alias("n")).where("n = 1")
    state = single.join(stops.select("node").distinct(), "node", "left_anti").select("node", "up", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done"))
    state = table(state, "pointers")
    limit, span = state.count(), 1
    while span <= 2 * limit:
        next_ = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(next_, "up", "left")
        moved = moved.select("node", F.coalesce("_up", "up").alias("up"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.coalesce("_done", F.lit(True)).alias("done"))
        after = table(state.where("done").union(moved), "pointers")
        drop_table(state)
        state, span = after, span * 2
        if state.where("NOT done").isEmpty():
            break
    return state.where("done").select("node", F.col("up").alias("anchor"), "hops")


def _between(edges: DataFrame, hung: DataFrame, stops: DataFrame | None) -> DataFrame:
    """(a, b, hops): ways from anchor to anchor, for nodes b with several parents; into stops there are none."""
    several = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select("child")
    if stops is not None:
        several = several.join(stops.select(F.col("node").alias("child")), "child", "left_anti")
    into = edges.join(several, "child").join(hung.withColumnRenamed("node", "parent"), "parent", "left")
    return into.select(F.coalesce("anchor", "parent").alias("a"), F.col("child").alias("b"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))


def descendants(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): roots (node) and all that edges (parent, child) lead to, once each, at the least depth. Cycles are
    walked once."""
    edges, roots = table(_clean(edges), "edges"), table(roots.select("node").where("node IS NOT NULL").distinct(), "roots")
    hung = anchors(edges, roots)
    ways = table(_between(edges, hung, roots), "ways")
    known = front = table(roots.select("node", F.lit(0).cast("long").alias("depth")), "known")
    while not ways.isEmpty():
        found = ways.join(front, F.col("a") == F.col("node")).groupBy("b").agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
        old = known.select(F.col("node").alias("b"), F.col("depth").alias("_depth"))
        better = found.join(old, "b", "left").where("_depth IS NULL OR depth < _depth").select(F.col("b").alias("node"), "depth")
        front = table(better, "front")
        if front.isEmpty():
            break
        known = table(known.join(front, "node", "left_anti").union(front), "known")
    below = hung.join(known.withColumnRenamed("node", "anchor"), "anchor").select("node", (F.col("depth") + F.col("hops")).alias("depth"))
    return known.union(below)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): the length of the longest way to each of nodes (node), from 0 for those without a parent.

    Edges with an end that isn't among nodes are ignored. Nodes on or below a cycle are in no layer and left out."""
    nodes = table(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    known = lambda end: nodes.select(F.col("node").alias(end))
    every = table(_clean(edges).join(known("parent"), "parent").join(known("child"), "child").select("parent", "child"), "edges")
    # ends of all ways are most of many graphs: they have no say in others' layers and follow from their parents' in one join
    ends = every.select("child").subtract(every.select("parent"))
    ends = table(ends, "ends")
    inner = nodes.join(ends.withColumnRenamed("child", "node"), "node", "left_anti")
    found = table(_inner_layers(table(inner, "inner"), table(every.join(ends, "child", "left_anti").select("parent", "child"), "edges")), "layers")
    below = every.join(ends, "child", "left_semi").join(found.withColumnRenamed("node", "parent"), "parent", "left")
    below = below.groupBy(F.col("child").alias("node")).agg((F.max("layer") + 1).alias("layer"), F.count_if(F.col("layer").isNull()).alias("_open"))
    return found.union(below.where("_open = 0").select("node", "layer"))


def _inner_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """layers() of distinct nodes and distinct edges between them."""
    known = lambda end: nodes.select(F.col("node").alias(end))
    hung = anchors(edges, nodes.limit(0))
    ways = table(_between(edges, hung, None), "ways")
    tops = nodes.join(known("child").join(edges, "child", "left_semi").withColumnRenamed("child", "node"), "node", "left_anti")
    front = done = table(tops.select("node", F.lit(0).cast("long").alias("layer")), "layer")
    # a node's open ways and the longest of the others so far
    open_ = table(ways.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("open"), F.lit(0).cast("long").alias("layer")), "open")
    while not (open_.isEmpty() or front.isEmpty()):
        came = ways.join(front, F.col("a") == F.col("node")).groupBy("b").agg(F.count("*").alias("_n"), F.max(F.col("layer") + F.col("hops")).alias("_layer"))
        left = open_.join(came, F.col("node") == F.col("b"), "left")
        left = left.select("node", (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open"), F.greatest("layer", F.coalesce("_layer", F.lit(0))).alias("layer"))
        after = table(left, "open")
        drop_table(open_)
        front = table(after.where("open = 0").select("node", "layer"), "layer")
        open_, done = after.where("open > 0"), done.union(front)
    below = hung.join(done.withColumnRenamed("node", "anchor"), "anchor").select("node", (F.col("layer") + F.col("hops")).alias("layer"))
    return done.union(below)
