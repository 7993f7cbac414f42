"""Mixing sources to target weights by systematic sampling.

A document's expected copies are the ratio of its source's target to its source's size.
Within a source the expected copies are prefix-summed in order of size (so that each stretch
of the line holds documents of like length), one random offset is added, and a document is
emitted once for each integer boundary that its stretch crosses. The words taken then differ
from the target by about one largest document, whatever the order of the input.

The prefix sum is a rank times the ratio. Ranks come in two levels, so that no task holds a
whole source: counts per (source, size, bucket) are aggregated with map-side combining and
summed up over sizes, then over buckets, and only documents of one bucket are numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import n_words, stored

#: No source is taken more than this many times.
MOST_COPIES = 3
#: Buckets in which the documents of one source and size are numbered.
BUCKETS = 4096


def source_key(source: Column) -> Column:
    """A key without nulls that sorts by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``target`` for each row of ``sizes`` (``skey``, ``source_size``, one row per source).

    Sources in order of ``skey`` weigh ``cycle`` in turn and share all sizes; a target stops at ``most``
    times its source's size and the excess is reshared by weight. Water-filling in closed form: in
    ascending order of cap over weight, a source is full where its cap lies below the level of the rest.
    """
    line, everything = Window.orderBy("skey"), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(line) - 1) % len(cycle)) + 1)
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    from_here = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.select(
        "skey", "source_size", "weight", "cap",
        F.sum("source_size").over(everything).cast("double").alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.sum("weight").over(from_here).alias("weight_left"),
    )
    rows = rows.withColumn("level", (F.col("all") - F.col("cap_before")) / F.col("weight_left"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return rows.select("skey", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def offset(skey: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): 32 bits of an MD5 over the seed and the source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), skey)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``src``, ``size``, ``source_size``, ``target``, ``copies`` of every row, and the ``carry`` columns (named ``carry_0``, ...).

    ``size`` is the number of words (null text: 0). Every row gets a number of copies from 0 to 3, equal
    within one to target over size of its source; a source of no words gets none. Null sources are one source.
    Rows of equal source, size and id are numbered by their text's hash, rows without an id in buckets of it; which of two identical rows comes
    first changes nothing. Reruns agree. No rows give no rows. Columns not named are neither read nor returned.
    """

    def measured(*more: Column) -> DataFrame:
        rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"), *more)
        return rows.withColumn("skey", source_key(F.col("src"))).withColumn("bucket", F.pmod(F.coalesce("id", "tie", F.lit(0)), F.lit(BUCKETS)).cast("int"))

    narrow, _ = stored(measured(), "sizes")  # every size and rank below is read from here
    rows = measured(*[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]) if carry else narrow
    counts = narrow.groupBy("skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    per_size = counts.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    per_source = targets(per_size.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    lower_sizes = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    lower_buckets = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_size.select("skey", "size", F.coalesce(F.sum("n").over(lower_sizes), F.lit(0)).alias("base"))
    buckets = counts.select("skey", "size", "bucket", F.coalesce(F.sum("n").over(lower_buckets), F.lit(0)).alias("part"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = buckets.join(starts, ["skey", "size"]).join(per_source, "skey").select("skey", "size", "bucket", (F.col("base") + F.col("part")).alias("base"), "source_size", "target", ratio.alias("ratio"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("id", "tie")))
    at, shift = F.col("base") + F.col("rank"), offset(F.col("skey"), seed)
    copies = F.floor(F.col("ratio") * at + shift) - F.floor(F.col("ratio") * (at - 1) + shift)
    return ranked.join(plan, ["skey", "size", "bucket"]).select("id", "src", "size", "source_size", "target", copies.cast("int").alias("copies"), *[f"carry_{i}" for i in range(len(carry))])
