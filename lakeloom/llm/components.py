"""Distributed union-find: the connected components of a table of links.

Alternating large-star and small-star rounds turn any forest of links into stars whose
centre is the smallest node, in a number of rounds logarithmic in the longest chain.
Each round is two aggregations with map-side combining and two equi-joins, so a hub of
many links is pre-aggregated before the shuffle and its join side is split by AQE.
Rounds end in a written table; nothing is collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import forget, stored, tidy


def _are_stars(links: DataFrame) -> bool:
    """Whether each lower end is a root and each upper end has one link."""
    seen = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    bad = seen.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 OR (up = 1 AND root = 1)")
    return bad.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Component of every node that has a link.

    ``links`` has one row per undirected link between ``a`` and ``b`` (any orderable type;
    rows with a null end, repeated rows and self links change nothing). Returns ``node`` and
    ``root``, the smallest node of its component, once for each linked node, roots included.
    An empty table gives an empty result.
    """
    spark = links.sparkSession
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNull().alias("na"), F.col(b).isNull().alias("nb"))
    now, path = stored(ends.where("NOT na AND NOT nb AND u <> v").select("u", "v").distinct(), "links")
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after, after_path = stored(small.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct(), "links")
        forget(spark, path)
        now, path = after, after_path
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    tidy(spark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
