"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeloom.llm import langid, linededup, mixing, pieces, quality, secretscan, simhash, tokencount, tokenfile, vecdedup

LONG = " ".join(f"word{i % 997}" for i in range(60_000)) + "\n" + "x" * 100_000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("id", "fp", "line", "size", "node", "root", "hash", "n", "copies", "quality", "broken", "component", "src", "words")


def edge_rows():
    prose = "the cat sat on the mat and looked at the dog with great care " * 8
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n\t ", None, "b", 4),
        (None, "no id here", "en", "b", 10), (6, LONG, "en", "b", len(LONG)), (7, "12 34 !!", "fr", None, 8), (8, "le chat est sur la table et il regarde le chien\n" * 3, "fr", "b", 5), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(docs, none):
    got = quality.judged(docs).select("doc_id", "quality", "broken").collect()
    assert len(got) == len(edge_rows())
    by = {r["doc_id"]: r["quality"] for r in got}
    assert by[4]["n_words"] == by[5]["n_words"] == by[3]["n_words"] == 0 and by[6]["n_words"] == 60_001
    assert quality.judged(none).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(edge_rows())
    by = {r["id"]: r for r in got}
    assert by[2]["component"] == 1 and by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0 and by[5]["component"] == 3
    assert simhash.near_duplicates(none).count() == 0


def test_lines(docs, none):
    got = {r["id"]: r for r in linededup.decisions(docs).collect()}
    assert len(got) == len({r[0] for r in edge_rows()})
    assert got[1]["n_dropped"] == 0 and got[2]["n_dropped"] == 1 and got[8]["dropped"] == [1, 2] and got[3]["n_lines"] == 0
    back = linededup.deduplicated(docs)
    assert back.columns == docs.columns and back.count() == len(edge_rows())
    assert linededup.decisions(none).count() == 0 and linededup.deduplicated(none).count() == 0


def test_token_counts(docs, none):
    path = P.path("word_bpe_49k.json")
    got = {r["id"]: r for r in tokencount.token_counts(docs, path, 2048).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == got[5]["n_tokens"] == 0 and got[6]["within"] < len(LONG)
    tables = {r["id"]: r["counts"] for r in tokencount.prefix_tables(docs.where("doc_id IN (3, 4, 8)"), path).collect()}
    assert tables[3] == tables[4] == [0] and tables[8][-1] == got[8]["n_tokens"]
    assert tokencount.token_counts(none, path, 2048).count() == 0


def test_language(docs, none):
    model = langid.fitted(docs)
    got = {r["id"]: r for r in langid.identified(docs, model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[7]["lang_pred"] == "und" and got[7]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = langid.fitted(none)
    assert empty.langs == () and langid.identified(none, empty).count() == 0 and langid.identified(docs, empty).where("rejected").count() == len(edge_rows())


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r["copies"] <= 3 for r in got)
    assert {r["src"] for r in got} == {"a", "b", None} and all(r["copies"] == mixing.mix(docs).where(F.col("id") == r["id"]).first()["copies"] for r in got if r["id"] in (1, 6))
    assert mixing.mix(none).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (10, [1.0, 0.01], 0), (10, [1.0, 0.01], 0), (11, [1.0, 0.0, 0.0], 0), (12, [], 0),
        (5, [0.0, 1.0], 7), (5, [1.0, 0.0], 7), (13, [1.0, 0.01], 7), (None, [1.0, 0.01], 7), (None, [0.0, -1.0], 7), (None, [3.0, 0.0], 8),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit("clash")).withColumn("e", F.lit("clash"))
    got = sorted((r["id"] or 99, r["n_links"], r["component"] or 99) for r in vecdedup.near_duplicates(df).collect())
    # One id with different vectors: each vector has its own links; a null id links too.
    assert got == [(1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (5, 0, 5), (5, 2, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 3, 1), (10, 3, 1), (11, 0, 11), (12, 0, 12), (13, 2, 5), (99, 0, 99), (99, 0, 99), (99, 2, 5)]
    assert vecdedup.near_duplicates(df.limit(0)).count() == 0


def test_secrets(docs, none):
    got = secretscan.scan(docs).collect()
    assert len(got) == len(edge_rows()) and all(r["base"] == [] for r in got)
    assert secretscan.scan(none).count() == 0


def test_pieces(docs, none):
    path = P.path("piece_bpe_32k.model")
    got = {r["id"]: r for r in pieces.segmented(docs, path, with_ids=True).collect()}
    assert all(r["exact"] for r in got.values()) and got[4]["n_pieces"] == 1
    assert pieces.segmented(none, path).count() == 0


def test_token_files(docs, none):
    path = P.path("byte_bpe_50k.json")
    got = tokenfile.read_corpus(tokenfile.write_corpus(docs, path)).orderBy("start").collect()
    assert len(got) == len(edge_rows()) and [r["start"] for r in got][:2] == [0, got[0]["n_tokens"]]
    assert [r["id"] for r in got if r["id"]] == sorted(r[0] for r in edge_rows() if r[0])
    assert tokenfile.read_corpus(tokenfile.write_corpus(none, path)).count() == 0


def test_stages(spark, docs, none, sf):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "encode":
            assert out.columns == docs.columns, name
        assert out.count() <= 3 * len(edge_rows())
        assert stage(spark, none, sf).count() == 0, name
