"""Paging, profiles, sets, cells and aggregations over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.operators import timeline
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, r - 1 AS row, ((r - 1) // 1024)::BIGINT AS block FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)")
def page_block(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return timeline.blocks(table(spark, d, "lineitem").select(*keys), keys)


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) > 300 FROM orders) AS has_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300")
def limit_has_more(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(301).select("o_orderkey", "o_totalprice")
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return ranked.withColumn("has_more", F.max(F.col("rank") > 300).over(Window.partitionBy())).where("rank <= 300").drop("rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000")
def limit_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(1000).limit(50)


@query("SELECT least(count(*), 100000) AS n, count(*) <= 100000 AS exact FROM lineitem")
def bounded_count(spark, d):
    n = table(spark, d, "lineitem").limit(100001).agg(F.count(F.lit(1)).alias("c"))
    return n.select(F.least("c", F.lit(100000)).alias("n"), (F.col("c") <= 100000).alias("exact"))


_PROFILED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "documents": ["doc_id", "lang", "source"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distincts FROM {t}" for t, cs in _PROFILED.items() for c in cs))
def table_profile(spark, d):
    """Rows, nulls and distinct values per column; one pass over each table."""
    out = []
    for t, cols in _PROFILED.items():
        df = table(spark, d, t)
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k_{c}") for c in cols], *[F.count_distinct(c).alias(f"d_{c}") for c in cols])
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(f"k_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distincts")) for c in cols]))
        out.append(one.select(F.lit(t).alias("table_name"), "n", cells.alias("c")).select("table_name", "c.column_name", F.col("n").alias("row_count"), "c.nulls", "c.distincts"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query("SELECT doc_id, i::INT AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i <= 20000")
def numbered_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where("pos < 20000").select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


@query("""WITH c AS (SELECT page_id, unnest(string_split(url, '/')) AS cell, generate_subscripts(string_split(url, '/'), 1)::INT AS col FROM pages), b AS (SELECT *, regexp_replace(cell, '[   ]', '', 'g') AS bare FROM c)
SELECT page_id, col, cell, CASE WHEN num THEN 'number' ELSE 'text' END AS kind, CASE WHEN num THEN replace(bare, ',', '.')::DOUBLE END AS num FROM (SELECT *, (regexp_matches(bare, '^[+-]?[0-9]{1,15}$') OR (regexp_matches(bare, '^[+-]?[0-9]+[.,][0-9]+$') AND length(bare) <= 40)) AS num FROM b)""")
def delimited_cells(spark, d):
    cells = table(spark, d, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("pos", "cell"))
    return cells.select("page_id", (F.col("pos") + 1).alias("col"), "cell", tx.typed(F.col("cell")).alias("t")).select("page_id", "col", "cell", "t.kind", "t.num")


@query("SELECT doc_id, (k * 16)::BIGINT AS at, lower(substr(h, k * 32 + 1, 32)) AS bytes FROM (SELECT doc_id, h, unnest(range(0, (length(h) + 31) // 32)) AS k FROM (SELECT doc_id, substr(hex(encode(text)), 1, 524288) AS h FROM documents))")
def hex_dump(spark, d):
    """Whole documents, up to the dump's own bound of 256 KiB."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(tx.hex_dump(F.encode("text", "UTF-8"))).alias("r"))
    return rows.select("doc_id", F.conv("r.offset", 16, 10).cast("long").alias("at"), F.replace("r.bytes", F.lit(" "), F.lit("")).alias("bytes"))


@query("SELECT lang, bucket AS body_size FROM (SELECT lang, round(n_chars / 1000.0) * 1000 AS bucket, sum(n_chars) AS w FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY w DESC, bucket) = 1")
def weighted_mode(spark, d):
    b = table(spark, d, "documents").groupBy("lang", (F.round(F.col("n_chars") / 1000) * 1000).alias("bucket")).agg(F.sum("n_chars").alias("w"))
    return b.groupBy("lang").agg(F.max_by("bucket", F.struct("w", -F.col("bucket"))).alias("body_size"))


@query("SELECT DISTINCT p_brand, p_size, least(6, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC))::INT AS level FROM part")
def heading_rank(spark, d):
    rank = F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size")))
    return table(spark, d, "part").select("p_brand", "p_size").distinct().withColumn("level", F.least(F.lit(6), rank))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, event_type) AS k, count(*) OVER () AS kinds FROM c) SELECT event_type AS label, n FROM r WHERE k <= 3 UNION ALL SELECT (kinds - 3) || ' more', sum(n)::BIGINT FROM r WHERE k > 3 GROUP BY kinds")
def type_report(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))
    rest = r.where("k > 3").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" more")).alias("label"), F.sum("n").alias("n"))
    return r.where("k <= 3").select(F.col("event_type").alias("label"), "n").unionByName(rest.where("n IS NOT NULL"))


@query("WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, floor((value - lo) / (hi - lo) * 255)::BIGINT AS level FROM events, m")
def stretch_0_255(spark, d):
    e = table(spark, d, "events")
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    m = e.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    return e.crossJoin(m).select("event_id", F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).alias("level"))  # one row of bounds


@query("SELECT q, count(*) AS n, min(vec_id) AS first_id FROM (SELECT vec_id, list_transform(embedding, lambda x: trunc(x * 10)::INT) AS q FROM embeddings) GROUP BY q")
def quantised_dedup(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * 10).cast("int")).alias("q"))
    return v.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query("WITH l AS (SELECT unnest([16, 8, 4, 2]) AS levels), k AS (SELECT levels, count(DISTINCT floor(c_acctbal / (12000.0 / levels / 8))) AS n FROM customer, l GROUP BY levels) SELECT levels, n FROM k WHERE n <= 48 ORDER BY levels DESC LIMIT 1")
def adaptive_levels(spark, d):
    counts = table(spark, d, "customer").agg(*[F.count_distinct(F.floor(F.col("c_acctbal") / (12000.0 / n / 8))).alias(f"n{n}") for n in (16, 8, 4, 2)])
    fits = F.filter(F.array(*[F.struct(F.lit(n).alias("levels"), F.col(f"n{n}").alias("n")) for n in (16, 8, 4, 2)]), lambda s: s["n"] <= 48)
    return counts.select(F.explode(F.slice(fits, 1, 1)).alias("s")).select("s.levels", "s.n")


@query("SELECT user_id, arg_min(label, (ts, event_id)) AS label FROM (SELECT user_id, ts, event_id, coalesce(m.label, 'other') AS label FROM events LEFT JOIN (VALUES ('click', 'touch'), ('view', 'touch'), ('purchase', 'sale')) m(code, label) ON event_type = code) GROUP BY user_id")
def synonym_first(spark, d):
    m = spark.createDataFrame([("click", "touch"), ("view", "touch"), ("purchase", "sale")], "event_type string, label string")
    e = table(spark, d, "events").join(F.broadcast(m), "event_type", "left").withColumn("label", F.coalesce("label", F.lit("other")))  # three fixed rows
    return e.groupBy("user_id").agg(F.min_by("label", F.struct("ts", "event_id")).alias("label"))


@query("SELECT event_id, coalesce(props->>'$.seed', props->>'$.k') AS found FROM events")
def json_alias(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.seed"), F.get_json_object("props", "$.k")).alias("found"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_custkey % 3 <> 0)")
def dangling_edges(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0")
    o = table(spark, d, "orders")
    return o.join(known, o.o_custkey == known.c_custkey, "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0")
def kept_edges(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 3 <> 0")
    o = table(spark, d, "orders")
    return o.join(known, o.o_custkey == known.c_custkey).select("o_orderkey", "c_name")


@query("WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS ahead, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS behind")
def ahead_behind(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    a, b = docs.where("doc_id % 3 <> 0").withColumn("l", F.lit(True)), docs.where("doc_id % 4 <> 0").withColumn("r", F.lit(True))
    return a.join(b, "doc_id", "full_outer").agg(F.count_if(F.col("r").isNull()).alias("ahead"), F.count_if(F.col("l").isNull()).alias("behind"))


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS is_local FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def local_flag(spark, d):
    marked = table(spark, d, "labels").select("doc_id").distinct().withColumn("m", F.lit(True))
    return table(spark, d, "documents").join(marked, "doc_id", "left").select("doc_id", F.col("m").isNotNull().alias("is_local"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS staged, count(*) FILTER (l_linestatus = 'F') AS unstaged FROM lineitem GROUP BY 1")
def staged_split(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("staged"), F.count_if(F.col("l_linestatus") == "F").alias("unstaged"))


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS largest, max(o_totalprice) AS price FROM orders GROUP BY 1")
def largest_of(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"), F.max("o_totalprice").alias("price"))


@query("SELECT 'orders_unique' AS rule, count(*) - count(DISTINCT o_orderkey) AS broken FROM orders UNION ALL SELECT 'orders_status', count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) FROM orders UNION ALL SELECT 'documents_required', count(*) FILTER (text IS NULL OR source IS NULL) FROM documents")
def manifest_checks(spark, d):
    o, docs = table(spark, d, "orders"), table(spark, d, "documents")
    rows = [
        o.agg((F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("broken")).select(F.lit("orders_unique").alias("rule"), "broken"),
        o.agg(F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")).alias("broken")).select(F.lit("orders_status").alias("rule"), "broken"),
        docs.agg(F.count_if(F.col("text").isNull() | F.col("source").isNull()).alias("broken")).select(F.lit("documents_required").alias("rule"), "broken"),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_fixed_depth(spark, d):
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9A-Za-z_]+'))::BIGINT AS n FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9A-Za-z_]+"), F.lit(0))).cast("long").alias("n"))


@query("SELECT l_orderkey % 100 AS k, unnest(list_transform(range(0, l_linenumber), lambda i: l_quantity)) AS v FROM lineitem")
def run_length_expansion(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select((F.col("l_orderkey") % 100).alias("k"), F.explode(F.array_repeat("l_quantity", F.col("l_linenumber"))).alias("v"))


@query("SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source")
def channel_grouping(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
