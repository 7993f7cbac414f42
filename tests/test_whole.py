"""Queries over whole tables and whole texts at the scale of the correctness check."""

from __future__ import annotations

import oracle
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.operators import graph
from lakeloom.plans import catalogue

NAMES = ["chained_offsets", "dag_layers", "descendants", "faces_by_owner", "parents_first", "run_length_expansion", "hex_dump", "text_forms", "quantised_dedup"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, name):
    d = "/root/testdata/sf0.01"
    assert oracle.differences(catalogue.QUERIES[name](spark, d), oracle.connection(d), catalogue.ORACLES[name]) == ""


def test_dump_ends_at_its_bound(spark):
    rows = spark.createDataFrame([("x" * 262150,)], "text string").select(F.explode(tx.hex_dump(F.encode("text", "UTF-8"))).alias("r"))
    assert rows.count() == 16384


def test_deep_and_cyclic_graphs(spark):
    n = 90
    chain = spark.createDataFrame([(k, k - 1 if k else None, float(k)) for k in range(n)], "node bigint, parent bigint, value double")
    assert {r["node"]: r["total"] for r in graph.chain_sums(chain).collect()} == {k: k * (k + 1) / 2 for k in range(n)}
    edges = chain.where("parent IS NOT NULL").select("parent", F.col("node").alias("child"))
    assert graph.descendants(edges, chain.where("node = 0").select("node")).agg(F.max("depth")).first()[0] == n - 1
    loop = spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint")
    with pytest.raises(RuntimeError, match="cycle"):
        graph.layers(loop, loop.select(F.col("src").alias("node")), most=9)
    with pytest.raises(RuntimeError, match="cycle"):
        graph.chain_sums(loop.select(F.col("src").alias("node"), F.col("dst").alias("parent"), F.lit(1.0).alias("value")), most=9)


def test_open_references(spark, tmp_path):
    """References that no semicolon ends, as where a title is cut, stay as they are written."""
    texts = ["cut &amp", "&&&amp &amp; &lt;b&gt; &quot", "a &copy 2 &copy; &middot &middot;", "&amp;amp; &amplt; &am"]
    rows = [(k, f"http://h/{k}", f'<html><head><title>{t}</title></head><body><h1>{t}</h1><p>{t} <a href="/x?a=1&amp;b=2">{t}</a></p></body></html>') for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert oracle.differences(catalogue.QUERIES["html_markdown"](spark, str(tmp_path)), oracle.connection(str(tmp_path)), catalogue.ORACLES["html_markdown"]) == ""
