"""Trees given as paths: ancestors, roll-ups, top parts with the rest, marks, children (A-04, A-24, G-02, G-03, J-21, J-22, O-03, P-04, P-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.rounds import cut


def ancestors(path: Column, itself: bool = True) -> Column:
    """Folders above a path, the root (an empty string) first, with the path itself last if asked for."""
    parts = F.split(path, "/")
    upto = F.size(parts) - (0 if itself else 1)
    return F.transform(F.sequence(F.lit(0), upto), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def rollup(entries: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """``node``, ``parent``, ``depth``, ``size`` and ``files`` of every folder and file: a file adds to itself and all above.

    The sums combine before the shuffle, so the root, which every file feeds, costs one row per task.
    """
    rows = entries.select(F.explode(ancestors(F.col(path))).alias("node"), F.col(size).alias("size"))
    sums = rows.groupBy("node").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))
    depth = F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", "/")))
    return sums.select("node", F.when(F.col("node") == "", None).otherwise(parent(F.col("node"))).alias("parent"), depth.alias("depth"), "size", "files")


def top_rest(nodes: DataFrame, slices: int = 12, rings: int = 3) -> DataFrame:
    """The ``slices`` largest children of each kept folder, and one row for the rest: ``parent``, ``label``, ``size``, ``rank``, ``is_rest``.

    Children of no size are left out. Only folders that are themselves among the kept ones are opened, ``rings`` deep.
    """
    slices, rings = max(3, slices), max(1, rings)
    by_size = Window.partitionBy("parent").orderBy(F.desc("size"), "node")
    # The roll-up and the ranks are read for every ring.
    ranked = cut(nodes.where("size > 0 AND parent IS NOT NULL").withColumn("rank", F.row_number().over(by_size)))
    shown = None
    kept = nodes.sparkSession.sql("SELECT '' AS node")
    for _ in range(rings):
        ring = ranked.join(kept.withColumnRenamed("node", "parent"), "parent", "left_semi")
        shown = ring if shown is None else shown.unionByName(ring)
        kept = ring.where(F.col("rank") <= slices).select("node")
    top = shown.where(F.col("rank") <= slices).select("parent", F.col("node").alias("label"), "size", F.col("rank"), F.lit(False).alias("is_rest"))
    rest = shown.where(F.col("rank") > slices).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    rest = rest.select("parent", F.concat(F.col("n").cast("string"), F.lit(" more")).alias("label"), "size", F.lit(slices + 1).alias("rank"), F.lit(True).alias("is_rest"))
    return top.unionByName(rest)


def topmost(marks: DataFrame, path: str = "path") -> DataFrame:
    """Marks that no other mark covers."""
    marks = marks.select(F.col(path).alias("path"))
    above = marks.select("path", F.explode(ancestors(F.col("path"), itself=False)).alias("above"))
    covered = above.join(marks.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path").distinct()
    return marks.distinct().join(covered, "path", "left_anti")


def nearest_marked(entries: DataFrame, marks: DataFrame, path: str = "path") -> DataFrame:
    """For each entry the nearest mark at or above it, null without one."""
    entries = entries.select(F.col(path).alias("path"))
    up = entries.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "marked"))
    hit = up.join(marks.select(F.col(path).alias("marked")).distinct(), "marked").groupBy("path").agg(F.max_by("marked", "depth").alias("marked"))
    return entries.distinct().join(hit, "path", "left")


def children(entries: DataFrame, prefix: str, path: str = "path", size: str = "size") -> DataFrame:
    """Immediate children under ``prefix``, folders implied by deeper paths included: ``name``, ``is_folder``, ``size``, ``files``."""
    p = F.col(path)
    inside = entries.where(p.startswith(prefix)).select(F.substring(p, F.lit(len(prefix) + 1), F.length(p)).alias("tail"), F.col(size).alias("size")).where("tail <> ''")
    head = F.regexp_extract("tail", "^([^/]+)", 1)
    return inside.groupBy(head.alias("name")).agg(F.max(F.instr("tail", "/") > 0).alias("is_folder"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))


def implied_folders(entries: DataFrame, path: str = "path") -> DataFrame:
    """Every folder that some path implies, once, with its depth."""
    up = entries.select(F.explode(ancestors(F.col(path), itself=False)).alias("folder")).where("folder <> ''").distinct()
    return up.select("folder", F.size(F.split("folder", "/")).alias("depth"))


def marked_totals(entries: DataFrame, marks: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """``marked``, ``size`` and ``files`` of every mark that no other covers (A-24): what deleting the marks would free, nothing twice."""
    up = entries.select(F.explode(ancestors(F.col(path))).alias("path"), F.col(size).alias("size"))
    return up.join(topmost(marks, path), "path").groupBy(F.col("path").alias("marked")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("files"))
