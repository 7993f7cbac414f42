"""Graphs given as parent or edge tables: descendants, layers, sums along chains (G-01, G-04, J-26, W-18, W-19).

Rounds end in the checkpoint folder and go on until nothing is new. A cycle would never end, so a number of rounds that no
acyclic input of its kind needs raises instead of giving a part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.rounds import cut
from lakeloom.operators.timeline import blocks

#: Rounds after which a graph counts as cyclic; pointer doubling needs the logarithm of its depth alone.
MOST_ROUNDS, MOST_DOUBLINGS = 10_000, 64


def descendants(edges: DataFrame, roots: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """``root``, ``node``, ``depth`` of all below the roots in a tree of ``parent``, ``child``, the roots themselves at depth 0."""
    front = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    found = [front]
    for k in range(1, most + 1):
        front = cut(front.join(edges, front.node == edges.parent).select("root", F.col("child").alias("node"), F.lit(k).alias("depth")))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(front)
    raise RuntimeError(f"more than {most} levels: is there a cycle?")


def layers(edges: DataFrame, nodes: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """``node`` and ``layer``: one more than the deepest feeder's; a node without feeders has 0.

    Each round holds only the distinct nodes that the round before feeds; a node's layer is the last round that reached it.
    """
    front = nodes.select("node")
    reached = [nodes.select("node", F.lit(0).alias("layer"))]
    for k in range(1, most + 1):
        front = cut(front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct())
        if front.isEmpty():
            return reduce(DataFrame.unionByName, reached).groupBy("node").agg(F.max("layer").alias("layer"))
        reached.append(front.select("node", F.lit(k).alias("layer")))
    raise RuntimeError(f"more than {most} layers: is there a cycle?")


def chain_sums(nodes: DataFrame, most: int = MOST_DOUBLINGS) -> DataFrame:
    """``node`` and ``total``: a node's value and those of all its ancestors, from ``node``, ``parent`` (null at a root) and ``value``.

    Pointer doubling: each round adds what the node pointed at has gathered and points on from there, so a chain of n takes log n rounds.
    A parent that is no node ends the chain.
    """
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    now = nodes.select("node", F.col("parent").alias("up"), F.col("value").alias("total")).join(known, "up", "left")
    now = cut(now.select("node", F.when(F.col("known"), F.col("up")).alias("up"), "total"))
    for _ in range(most):
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("node", "total")
        ahead = now.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("total").alias("gathered"))
        moved = now.where("up IS NOT NULL").join(ahead, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), (F.col("total") + F.col("gathered")).alias("total"))
        now = cut(moved.unionByName(now.where("up IS NULL")))
    raise RuntimeError("the chains have a cycle")


def commit_order(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """``commits`` (``node``, ``when``) with ``position`` from 0: no commit after its parents, of equal standing the newest first (W-20).

    ``edges`` lead from a parent (``src``) to its child (``dst``). Rows are numbered without gathering them in one task.
    """
    standing = layers(edges, commits.select("node"))
    rows = commits.join(standing, "node").withColumn("__up", -F.col("layer")).withColumn("__late", -F.unix_micros(F.col("when").cast("timestamp")))
    numbered = blocks(cut(rows), ["__up", "__late", "node"])
    return numbered.select("node", "when", F.col("row").alias("position"))
