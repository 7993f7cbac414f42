"""Range joins by binning, and tolerance chains (J-14 to J-16, W-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.timeline import islands


def containment(points: DataFrame, boxes: DataFrame, by: str, at: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points inside the intervals of the same ``by``: an equi-join on bins of ``width``, then the exact test.

    An interval is listed in each bin that it touches, a point in one, so a pair meets once. ``width`` of about
    an interval's length keeps both the listings and the candidates few.
    """
    binned = boxes.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    near = points.withColumn("__bin", F.floor(F.col(at) / width)).join(binned, [by, "__bin"])
    return near.where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("__bin")


def chains_merged(df: DataFrame, by: str, at: str, tolerance: float) -> DataFrame:
    """``by`` and ``kept``: of each group's values those kept when each is compared, ascending, with the last kept one.

    Where a value lies over the tolerance above the one before, the comparison starts anew, so only what lies between two such
    steps is gathered and read in order; a group of any size is cut at its steps.
    """
    cut_up = islands(df.select(by, at).where(F.col(at).isNotNull()), by, at, tolerance)
    runs = cut_up.groupBy(by, "island").agg(F.array_sort(F.collect_list(F.col(at).cast("double"))).alias("values"))
    return runs.select(by, F.explode(merge_near(F.col("values"), tolerance)).alias("kept"))


def merge_near(values: Column, tolerance: float) -> Column:
    """Of sorted values those kept when each is compared with the last kept one."""
    empty = F.array().cast("array<double>")
    step = lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > tolerance), F.concat(kept, F.array(v))).otherwise(kept)
    return F.aggregate(values, empty, step)


def covered(points: DataFrame, boxes: DataFrame, by: str, x: str, y: str, x0: str, x1: str, y0: str, y1: str, cell: float) -> DataFrame:
    """Points inside the rectangles of the same ``by``, edges included (J-15): an equi-join on the cells of a grid, then the exact test.

    A rectangle is listed in each cell that it touches, a point in one, so a pair meets once.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    listed = boxes.where((F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1))).withColumn("__i", F.explode(cells(x0, x1))).withColumn("__j", F.explode(cells(y0, y1)))
    placed = points.withColumn("__i", F.floor(F.col(x) / cell)).withColumn("__j", F.floor(F.col(y) / cell))
    near = placed.join(listed, [by, "__i", "__j"])
    return near.where((F.col(x) >= F.col(x0)) & (F.col(x) <= F.col(x1)) & (F.col(y) >= F.col(y0)) & (F.col(y) <= F.col(y1))).drop("__i", "__j")
