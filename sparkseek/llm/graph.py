"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm import common


def _compressed(moves: DataFrame) -> DataFrame:
    """moves (node, parent) with every parent replaced by the end of its chain.

    Only parents that move themselves are joined, each once: the centre of a
    star does not move, so it is no join key however many nodes point to it."""
    while True:
        parents = moves.select("parent").distinct()
        further = common.stored(parents.join(moves.select(F.col("node").alias("parent"), F.col("parent").alias("further")), "parent"), "further")
        if further.isEmpty():
            return moves
        moved = moves.join(further, "parent", "left").select("node", F.coalesce("further", "parent").alias("parent"))
        moves = common.stored(moved, "moves")


def merged(roots: DataFrame, moves: DataFrame) -> DataFrame:
    """roots (node, component) after components moved: moves (node, component) of former components."""
    step = moves.filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("further"))
    step = common.stored(roots.select("component").distinct().join(step, "component"), "steps")
    changed = roots
    if not step.isEmpty():
        changed = roots.join(step, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return common.stored(changed.select("node", "component").union(moves.select("node", "component").join(roots, "node", "left_anti")), "roots")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs or structs; component is its least node.

    Links that name a node with itself are kept as nodes.  In each round every
    node hooks to the least of its smaller neighbours, chains of hooks are
    followed to their ends by pointer doubling, and links are renamed by those
    ends: what then names one node twice is dropped, so the table of links
    shrinks with every round (a star ends in one) and is never doubled.  The
    state of each round is written to the shared folder; nothing is collected
    but whether links are left.
    """
    both = links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    both = common.stored(both.distinct(), "links")
    edges, roots = both.filter("u <> v"), None
    while True:
        moves = common.stored(edges.groupBy("v").agg(F.min("u").alias("parent")).withColumnRenamed("v", "node"), "moves")
        if moves.isEmpty():
            break
        moves = _compressed(moves).withColumnRenamed("parent", "component")
        roots = moves if roots is None else merged(roots, moves)
        of_v = moves.select(F.col("node").alias("v"), F.col("component").alias("new"))
        edges = edges.join(of_v, "v").select("u", F.col("new").alias("v")).filter("u <> v").distinct()
        of_u = moves.select(F.col("node").alias("u"), F.col("component").alias("new"))
        edges = edges.join(of_u, "u", "left").select(F.coalesce("new", "u").alias("u"), "v").filter("u <> v")
        edges = common.stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    if roots is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
