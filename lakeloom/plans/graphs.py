"""Graph and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import graph, timeline
from lakeloom.operators.rounds import cut
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table

_TREE = "n AS (SELECT event_id AS node, event_id // 2 AS parent FROM events)"


def _tree(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("node"), F.floor(F.col("event_id") / 2).alias("parent"))


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT node AS root, node, 0 AS depth FROM n WHERE node IN (1, 5, 9) UNION ALL SELECT r.root, n.node, r.depth + 1 FROM r JOIN n ON n.parent = r.node AND n.node <> r.node) SELECT * FROM r")
def descendants(spark, d):
    t = _tree(spark, d)
    edges = t.where("node <> parent").select("parent", F.col("node").alias("child"))
    return graph.descendants(edges, t.where("node IN (1, 5, 9)").select("node"))


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT node, 0 AS layer FROM n WHERE parent NOT IN (SELECT node FROM n WHERE node > 0) OR node <= 0 UNION ALL SELECT n.node, r.layer + 1 FROM r JOIN n ON n.parent = r.node AND n.node <> r.node AND n.node > 1) SELECT node, max(layer)::INT AS layer FROM r GROUP BY node")
def dag_layers(spark, d):
    t = _tree(spark, d)
    edges = t.where("node > 1").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    return graph.layers(edges, t.select("node"))


@query(f"WITH RECURSIVE {_TREE}, r AS (SELECT node, 0 AS layer FROM n WHERE node <= 1 UNION ALL SELECT n.node, r.layer + 1 FROM r JOIN n ON n.parent = r.node AND n.node > 1) SELECT node, row_number() OVER (ORDER BY layer, node) AS position FROM r")
def parents_first(spark, d):
    t = _tree(spark, d)
    edges = t.where("node > 1").select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    numbered = timeline.blocks(cut(graph.layers(edges, t.select("node"))), ["layer", "node"])
    return numbered.select("node", (F.col("row") + 1).cast("long").alias("position"))


@query("SELECT o_custkey AS node, count(*) AS fed, list_sort(list(DISTINCT o_orderstatus)) AS pins FROM orders GROUP BY 1")
def fed_set(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count(F.lit(1)).alias("fed"), F.array_sort(F.collect_set("o_orderstatus")).alias("pins"))


@query("SELECT l_partkey % 50 AS set_name, l_returnflag AS choice, count(*) AS n FROM lineitem GROUP BY ALL")
def variant_counts(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("set_name"), F.col("l_returnflag").alias("choice")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, field, arg_min(value, strength) AS value FROM (SELECT source, 'lang' AS field, lang AS value, doc_id AS strength FROM documents WHERE lang IS NOT NULL UNION ALL SELECT source, 'size', n_chars::VARCHAR, doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY ALL")
def layered_opinions(spark, d):
    docs = table(spark, d, "documents")
    said = docs.where("lang IS NOT NULL").select("source", F.lit("lang").alias("field"), F.col("lang").alias("value"), F.col("doc_id").alias("strength")).unionByName(
        docs.where("doc_id % 2 = 0").select("source", F.lit("size").alias("field"), F.col("n_chars").cast("string").alias("value"), F.col("doc_id").alias("strength"))
    )
    return said.groupBy("source", "field").agg(F.min_by("value", "strength").alias("value"))


@query("WITH f AS (SELECT unnest([[l_partkey % 30, l_suppkey % 30, l_linenumber], [l_suppkey % 30, l_linenumber, l_partkey % 30]]) AS face FROM lineitem), s AS (SELECT list_sort(face) AS face FROM f) SELECT face, count(*) AS owners FROM s GROUP BY face HAVING count(*) = 1")
def faces_by_owner(spark, d):
    """Faces of one owner: what several cells share lies inside and goes."""
    rows = table(spark, d, "lineitem")
    a, b, c = F.col("l_partkey") % 30, F.col("l_suppkey") % 30, F.col("l_linenumber").cast("long")
    faces = rows.select(F.explode(F.array(F.array(a, b, c), F.array(b, c, a))).alias("face")).select(F.array_sort("face").alias("face"))
    return faces.groupBy("face").agg(F.count(F.lit(1)).alias("owners")).where("owners = 1")


@query("SELECT o_orderkey, coalesce(n.n_name, 'id ' || c_nationkey) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON c_nationkey = n.n_nationkey")
def name_or_id(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 4 <> 0")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")  # nation is a fixed table of 25 rows
    return rows.select("o_orderkey", F.coalesce("n_name", F.concat(F.lit("id "), F.col("c_nationkey").cast("string"))).alias("label"))

