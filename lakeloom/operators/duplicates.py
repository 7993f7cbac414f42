"""Content de-duplication (A-01, A-02, J-10, O-02) by size and digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 1024


def duplicate_members(df: DataFrame, path: str, content: str, floor: int = FLOOR) -> DataFrame:
    """``set_id``, ``size``, ``copies``, ``wasted`` and ``path`` of every row whose content another row has.

    Rows under ``floor`` bytes and null contents are left out. A content is digested where it is read, so that sizes and
    digests are shuffled and contents are not. Groups are counted, not gathered, so a set may be of any size.
    """
    size = F.octet_length(content).cast("long")
    near = df.select(F.col(path).alias("path"), size.alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("set_id")).where(F.col("size") >= floor)
    sets = near.groupBy("size", "set_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return near.join(sets, ["size", "set_id"]).select("set_id", "size", "copies", (F.col("size") * (F.col("copies") - 1)).alias("wasted"), "path")


def duplicate_sets(df: DataFrame, path: str, content: str, floor: int = FLOOR) -> DataFrame:
    """One row per set, the largest first: ``set_id``, ``size``, ``copies``, ``wasted`` and ``first_path``."""
    sets = duplicate_members(df, path, content, floor).groupBy("set_id", "size").agg(F.max("copies").alias("copies"), F.max("wasted").alias("wasted"), F.min("path").alias("first_path"))
    return sets.orderBy(F.desc("size"), "first_path")


def duplicate_totals(df: DataFrame, path: str, content: str, floor: int = FLOOR) -> DataFrame:
    """Rows seen, their bytes, sets, and bytes wasted."""
    seen = df.agg(F.count(F.lit(1)).alias("seen"), F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("bytes"))
    sets = duplicate_members(df, path, content, floor).groupBy("set_id", "size").agg(F.max("wasted").alias("w"))
    total = sets.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum("w"), F.lit(0)).alias("wasted"))
    return seen.crossJoin(total)  # one row each
