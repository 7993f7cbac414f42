"""As-of lookups, islands and sequences over ordered rows (J-11, J-28, W-01, W-02, W-04, W-05, W-09, W-13, W-15, W-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(probes: DataFrame, keys: DataFrame, by: str, at: str, value: str, mode: str = "hold") -> DataFrame:
    """``probes`` with ``found``: the value of the last key at or before the probe, or between keys.

    ``hold`` takes the last key's value, ``linear`` interpolates to the next; before the first key its value
    holds, after the last its. One shuffle by ``by``: probes and keys are united and read by two windows.
    Of keys at one moment the greatest value counts. Without keys, null. ``at`` is a number.
    """
    one = keys.groupBy(by, at).agg(F.max(value).alias("__v"))
    both = probes.withColumn("__v", F.lit(None).cast("double")).withColumn("__key", F.lit(0)).unionByName(
        one.withColumn("__key", F.lit(1)).withColumn("__v", F.col("__v").cast("double")), allowMissingColumns=True
    )
    # Keys sort before probes of the same moment.
    line = Window.partitionBy(by).orderBy(F.col(at), F.desc("__key"))
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    k = F.when(F.col("__key") == 1, F.struct(F.col(at).cast("double").alias("t"), F.col("__v").alias("v")))
    rows = both.withColumn("__l", F.last(k, True).over(before)).withColumn("__r", F.first(k, True).over(after)).where("__key = 0")
    left, right = F.col("__l"), F.col("__r")
    if mode == "hold":
        found = F.coalesce(left["v"], right["v"])
    elif mode == "linear":
        share = (F.col(at).cast("double") - left["t"]) / (right["t"] - left["t"])
        found = F.when(left.isNull(), right["v"]).when(right.isNull() | (right["t"] == left["t"]), left["v"]).otherwise(left["v"] + (right["v"] - left["v"]) * share)
    else:
        raise ValueError(f"unknown mode {mode}")
    return rows.withColumn("found", found).drop("__v", "__key", "__l", "__r")


def as_of_curved(probes: DataFrame, keys: DataFrame, by: str, at: str, value: str, leaving: str, arriving: str, second: float = 1.0) -> DataFrame:
    """``probes`` with ``found``: between keys the cubic that leaves and arrives with the given slopes per ``second`` (J-11).

    A key's slopes, one for leaving it and one for arriving at the next, belong to the stretch after it. Outside the keys the
    first or last value holds. One shuffle by ``by``.
    """
    one = keys.groupBy(by, at).agg(F.max_by(F.struct(F.col(value).cast("double").alias("v"), F.col(leaving).cast("double").alias("out"), F.col(arriving).cast("double").alias("into")), value).alias("__k"))
    both = probes.withColumn("__key", F.lit(0)).unionByName(one.withColumn("__key", F.lit(1)), allowMissingColumns=True)
    line = Window.partitionBy(by).orderBy(F.col(at), F.desc("__key"))
    k = F.when(F.col("__key") == 1, F.struct(F.col(at).cast("double").alias("t"), "__k.v", "__k.out", "__k.into"))
    rows = both.withColumn("__l", F.last(k, True).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__r", F.first(k, True).over(line.rowsBetween(0, Window.unboundedFollowing))).where("__key = 0")
    left, right = F.col("__l"), F.col("__r")
    span = right["t"] - left["t"]
    u = (F.col(at).cast("double") - left["t"]) / span
    cubic = (2 * u * u * u - 3 * u * u + 1) * left["v"] + (u * u * u - 2 * u * u + u) * left["out"] * span / second + (3 * u * u - 2 * u * u * u) * right["v"] + (u * u * u - u * u) * left["into"] * span / second
    found = F.when(left.isNull(), right["v"]).when(right.isNull() | (span == 0), left["v"]).otherwise(cubic)
    return rows.withColumn("found", found).drop("__k", "__key", "__l", "__r")


def islands(df: DataFrame, by: str, at: str, gap: float) -> DataFrame:
    """``df`` with ``island``: a number that steps up where the distance to the row before exceeds ``gap``."""
    line = Window.partitionBy(by).orderBy(at)
    step = F.when(F.col(at) - F.lag(at).over(line) > gap, 1).otherwise(0)
    return df.withColumn("__step", step).withColumn("island", F.sum("__step").over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__step")


def numbered_names(df: DataFrame, by: str, name: str, seq: str) -> DataFrame:
    """``df`` with ``unique_name``: the second of a name gets `` (2)``, and so on, in order of ``seq``."""
    n = F.row_number().over(Window.partitionBy(by, name).orderBy(seq))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def blocks(df: DataFrame, order: list[str], size: int = 1024) -> DataFrame:
    """``df`` with a row number from 0 and its block, without gathering the rows in one task.

    Rows are range-partitioned in order and numbered within partitions; partitions' row counts, one number each, are
    summed up and added.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    local = spread.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    out = local.join(base, "__p").withColumn("row", F.col("__b") + F.col("__i") - 1)
    return out.withColumn("block", F.floor(F.col("row") / size)).drop("__p", "__i", "__b")


def top_shares(df: DataFrame, by: str, weight: str, tie: str, n: int = 4) -> DataFrame:
    """The ``n`` heaviest rows of each group with ``share``, their weights scaled to sum to one."""
    best = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(weight), tie))).where(F.col("rank") <= n)
    total = F.sum(weight).over(Window.partitionBy(by))
    return best.withColumn("share", F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0)))
