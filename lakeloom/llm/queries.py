"""Queries of the training-data operators over the driver's tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import langid, linededup, mixing, pieces, quality, secretscan, simhash, sql, tokencount, tokenfile, vecdedup
from lakeloom.llm.common import spread


#: Where the public vocabularies lie; a parameter of each operator.
TOKENIZERS = "/opt/tokenizers"
TOKEN_LIMIT = 2048


def vocabulary(name: str) -> str:
    """The place of a vocabulary file."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole texts, the base rules and the verdict of the whole rule table."""
    q = F.col("quality")
    base = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    return quality.judged(_documents(spark, sf_dir)).select(
        "doc_id",
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & (F.size("broken") == 0)).alias("kept"),
        F.array_join("broken", ",").alias("broken_rules"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of whole texts: 4-word shingles, 4 differing bits."""
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of whole texts of which a near copy is kept elsewhere: 9-character shingles, similarity 0.8.

    All steps are SQL functions, as is asked for; they exceed the budget of CPU seconds (README).
    """
    found = linededup.decisions(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole texts, and the longest prefix within the limit."""
    found = tokencount.token_counts(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), TOKEN_LIMIT)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col("within").alias("chars_within_limit"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of whole texts, learnt from labelled documents that are not held out."""
    docs = _documents(spark, sf_dir)
    found = langid.identified(docs.withColumn("held_out", langid.held_out("doc_id")), langid.fitted(docs), carry=("held_out",))
    return found.select(F.col("id").alias("doc_id"), F.col("carry_0").alias("held_out"), "lang_pred", "score", "rejected")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a systematic sample takes of every document, sources mixed to their targets."""
    return mixing.mix(_documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 within labels, their components, and the recall of the search as audited by brute force."""
    found = vecdedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    recall, true = vecdedup.audit(found)
    kept = F.col("id").eqNullSafe(F.col("component"))
    audited = F.lit(recall).cast("double").alias("audited_recall"), F.lit(true).cast("long").alias("audited_links")
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"), *audited)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of whole texts; a document is a repository, its source the owner."""
    found = secretscan.scan(_documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(number, ("assign", "access", "hex")), F.sha2(secretscan.joined(F.col("base")), 256).alias("base_sha256"),
        secretscan.joined(F.col("spans")).alias("spans"), F.col("live").alias("n_live"), F.col("copied").alias("n_copied"), F.col("repositories").alias("most_repositories"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best segmentation of whole texts, its lead over the second best, and whether decoding gives the text back."""
    found = pieces.segmented(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_pieces", "score", "margin", "ids_crc32", "exact")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from range-coded token files."""
    files = tokenfile.write_corpus(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return tokenfile.read_corpus(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {
    "op1_quality": op1_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_files": op10_token_files,
    "op2_simhash": op2_simhash,
}

ORACLES: dict[str, str] = {
    "op1_quality": sql.quality(),
    "op6_mixing": sql.mixing(),
    "op8_secret_scan": sql.secrets(),
}
