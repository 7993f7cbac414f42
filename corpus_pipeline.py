"""The corpus pipeline: language, lines, near copies, mix, pieces; each stage a function of (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import langid, linededup, mixing, pieces, simhash
from lakeloom.llm.common import forget, stored
from lakeloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go, null texts and texts without a letter among them.

    Each row stands for itself, whatever its id. An empty table gives an empty one.
    """
    found = langid.identified(docs, langid.fitted(docs), carry=docs.columns)
    return found.where("NOT rejected").select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of which the corpus keeps a near copy; documents of which no word is left go, null and empty texts too.

    Rows of one id, or of none, with different texts are documents of their own; rows equal in id and text lose the same lines.
    An empty table gives an empty one.
    """
    out = linededup.deduplicated(docs)
    left = F.trim(F.col("text"), F.lit(linededup.BLANK)) != ""
    return out.where(left).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one of the smallest id; ids may repeat or be null, groups are told apart by fingerprints.

    Null and wordless texts are one group. An empty table gives an empty one.
    """
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times; wordless texts count nothing and are taken at their source's ratio.

    Each row stands for itself, whatever its id. An empty table gives an empty one.
    """
    mixed = mixing.mix(docs, carry=docs.columns)
    each = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col(f"carry_{i}").alias(c) for i, c in enumerate(docs.columns)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, and the figures of its best segmentation; a null text counts as an empty one.

    Rows repeat as they do in the mix. An empty table gives an empty one.
    """
    found = pieces.segmented(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)
    return found.select(F.col("id").alias("doc_id"), "n_pieces", "score", "margin", "ids_crc32", "exact", "ids")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: Learning, MinHash and fingerprints are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written in the shared folder and read back for the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            forget(spark, before)
        before = path
    return docs
