"""Reconciling two trees by a full outer join on the relative path (J-01, J-02, A-03, U-01, O-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT, DIFFERENT, EQUAL = "<", ">", "≠", "="


def _states(same: Column) -> Column:
    return (
        F.when(F.col("r.path").isNull(), LEFT).when(F.col("l.path").isNull(), RIGHT).when(~F.col("l.size").eqNullSafe(F.col("r.size")), DIFFERENT).when(same, EQUAL).otherwise(DIFFERENT)
    )


def reconcile(left: DataFrame, right: DataFrame, slack: int = 2, hide_equal: bool = True, by_content: bool = False) -> DataFrame:
    """State and both sides of every path of either tree (``path``, ``size``, ``modified``, and ``digest`` if by content).

    A size that differs decides; else the digests, or a distance of the times of more than ``slack`` seconds.
    Sides of equal size are the only ones whose digests are compared. Null times count as equal to each other only.
    """
    if by_content:
        same = F.coalesce(F.col("l.digest") == F.col("r.digest"), F.lit(False))
    else:
        apart = F.abs(F.unix_micros(F.col("l.modified").cast("timestamp")) - F.unix_micros(F.col("r.modified").cast("timestamp")))
        same = F.when(F.col("l.modified").isNull() | F.col("r.modified").isNull(), F.col("l.modified").eqNullSafe(F.col("r.modified"))).otherwise(apart <= slack * 1_000_000)
    joined = left.alias("l").join(right.alias("r"), F.col("l.path") == F.col("r.path"), "full_outer")
    out = joined.select(
        _states(same).alias("state"), F.coalesce("l.path", "r.path").alias("path"), F.col("l.size").alias("left_size"), F.col("l.modified").alias("left_modified"),
        F.col("r.size").alias("right_size"), F.col("r.modified").alias("right_modified"),
    )
    return (out.where(F.col("state") != EQUAL) if hide_equal else out).orderBy("path")


def state_counts(reconciled: DataFrame) -> DataFrame:
    """Rows of each state, in one pass."""
    count = lambda s: F.count_if(F.col("state") == s)
    return reconciled.agg(count(LEFT).alias("only_left"), count(RIGHT).alias("only_right"), count(DIFFERENT).alias("different"), count(EQUAL).alias("equal"))
