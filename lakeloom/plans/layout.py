"""Layout, table and record rules: lines of runs, strips, boxes, choices, chains, edits."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators import graph
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table

_RUNS = "r AS (SELECT c_nationkey AS page, c_custkey AS id, round(c_acctbal, 1) AS y, 10.0::DOUBLE + c_custkey % 5 AS size FROM customer)"


def _runs(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("id"), F.round("c_acctbal", 1).alias("y"), (F.lit(10.0) + F.col("c_custkey") % 5).alias("size"))


@query(f"WITH {_RUNS}, s AS (SELECT *, CASE WHEN abs(lag(y) OVER w - y) > greatest(1.5, 0.45 * least(size, lag(size) OVER w)) THEN 1 ELSE 0 END AS step FROM r WINDOW w AS (PARTITION BY page ORDER BY y, id)) SELECT page, id, (sum(step) OVER (PARTITION BY page ORDER BY y, id ROWS UNBOUNDED PRECEDING))::BIGINT AS line FROM s")
def line_grouping(spark, d):
    w = Window.partitionBy("page").orderBy("y", "id")
    far = F.abs(F.lag("y").over(w) - F.col("y")) > F.greatest(F.lit(1.5), F.least("size", F.lag("size").over(w)) * 0.45)
    rows = _runs(spark, d).withColumn("step", F.when(far, 1).otherwise(0))
    return rows.select("page", "id", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("line"))


@query(f"WITH {_RUNS}, g AS (SELECT page, id, y - max(y + size) OVER (PARTITION BY page ORDER BY y, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, y FROM r) SELECT page, round(arg_max(gap, (gap, -y)), 6) AS gap, round(arg_max(y, (gap, -y)), 1) AS ends_at FROM g WHERE gap IS NOT NULL GROUP BY page")
def widest_strip(spark, d):
    w = Window.partitionBy("page").orderBy("y", "id").rowsBetween(Window.unboundedPreceding, -1)
    gaps = _runs(spark, d).withColumn("gap", F.col("y") - F.max(F.col("y") + F.col("size")).over(w)).where("gap IS NOT NULL")
    best = F.struct("gap", -F.col("y"))
    return gaps.groupBy("page").agg(F.round(F.max_by("gap", best), 6).alias("gap"), F.round(F.max_by("y", best), 1).alias("ends_at"))


@query("WITH c AS (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS polygon FROM events) SELECT user_id, polygon::BIGINT AS polygon, count(*) AS corners, greatest(0, count(*) - 2) AS triangles FROM c GROUP BY ALL")
def polygon_boundaries(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "events").withColumn("polygon", F.coalesce(F.sum(F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)).over(w), F.lit(0)).cast("long"))
    return rows.groupBy("user_id", "polygon").agg(F.count(F.lit(1)).alias("corners")).withColumn("triangles", F.greatest(F.lit(0), F.col("corners") - 2))


@query("SELECT o_orderkey, CASE WHEN (o_orderkey // 1024) % 3 = 0 THEN first_value(o_totalprice) OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey) ELSE o_totalprice END AS value FROM orders")
def paged_constants(spark, d):
    rows = table(spark, d, "orders").withColumn("page", F.floor(F.col("o_orderkey") / 1024))
    first = F.first("o_totalprice").over(Window.partitionBy("page").orderBy("o_orderkey"))
    return rows.select("o_orderkey", F.when(F.col("page") % 3 == 0, first).otherwise(F.col("o_totalprice")).alias("value"))


@query("WITH m AS (SELECT o_orderkey, 1 AS rank, 'taken' AS label, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders UNION ALL SELECT o_orderkey, 2, 'digitised', strftime(o_orderdate + to_days((o_orderkey % 2)::INT), '%Y-%m-%d') FROM orders UNION ALL SELECT o_orderkey, 3, 'changed', strftime(o_orderdate + to_days((o_orderkey % 3)::INT), '%Y-%m-%d') FROM orders) SELECT o_orderkey, v, arg_min(label, rank) AS label FROM m GROUP BY o_orderkey, v")
def same_moment(spark, d):
    o = table(spark, d, "orders")
    day = lambda k: F.date_format(F.date_add("o_orderdate", k), "yyyy-MM-dd")
    stamps = F.array(F.struct(F.lit(1).alias("rank"), F.lit("taken").alias("label"), day(F.lit(0)).alias("v")), F.struct(F.lit(2).alias("rank"), F.lit("digitised").alias("label"), day((F.col("o_orderkey") % 2).cast("int")).alias("v")), F.struct(F.lit(3).alias("rank"), F.lit("changed").alias("label"), day((F.col("o_orderkey") % 3).cast("int")).alias("v")))
    return o.select("o_orderkey", F.explode(stamps).alias("s")).select("o_orderkey", "s.*").groupBy("o_orderkey", "v").agg(F.min_by("label", "rank").alias("label"))


@query("SELECT p_brand, round(p_retailprice / 50)::BIGINT AS x, p_size // 10 AS y, arg_min(p_partkey, ((p_partkey % 2), p_partkey)) AS kept, count(*) AS boxes FROM part GROUP BY ALL")
def distinct_boxes(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / 50).cast("long").alias("x"), F.floor(F.col("p_size") / 10).alias("y"))
    return rows.groupBy("p_brand", "x", "y").agg(F.min_by("p_partkey", F.struct(F.col("p_partkey") % 2, F.col("p_partkey"))).alias("kept"), F.count(F.lit(1)).alias("boxes"))


@query("SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) AS hi, count(*) AS n FROM supplier GROUP BY 1")
def tab_bounds(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT n_regionkey, n_nationkey, n_name, n_nationkey % 4 AS score FROM nation), o AS (SELECT n_regionkey, arg_max(n_name, (score, -n_nationkey)) AS name, max(score) AS score FROM s GROUP BY 1), p AS (SELECT arg_max(n_name, (score, -n_nationkey)) AS name FROM s) SELECT n_regionkey, CASE WHEN o.score >= 3 THEN o.name WHEN p.name IS NOT NULL THEN p.name ELSE o.name END AS chosen FROM o, p")
def scored_choice(spark, d):
    """A region's own best where it scores 3, else the parent's (of all nations)."""
    s = table(spark, d, "nation").withColumn("score", F.col("n_nationkey") % 4)
    best = F.max_by("n_name", F.struct("score", -F.col("n_nationkey")))
    own = s.groupBy("n_regionkey").agg(best.alias("name"), F.max("score").alias("score"))
    parent = s.agg(best.alias("inherited"))
    return own.crossJoin(parent).select("n_regionkey", F.when(F.col("score") >= 3, F.col("name")).otherwise(F.coalesce("inherited", "name")).alias("chosen"))  # the parent is one row


@query("SELECT * FROM (VALUES (1, ['p', 'a', 'b', 'z']), (2, ['e']), (3, ['p', 'b', 'b'])) v(id, items)")
def list_edit(spark, d):
    """An explicit list, or prepended, items and appended without the deleted; repeats stay."""
    rows = [(1, None, ["p"], ["a", "b"], ["z", "x"], ["x"]), (2, ["e"], ["p"], ["a"], [], []), (3, None, ["p"], ["b", "b"], [], ["q"])]
    t = spark.createDataFrame(rows, "id int, explicit array<string>, pre array<string>, items array<string>, post array<string>, gone array<string>")
    edited = F.filter(F.concat("pre", "items", "post"), lambda x: ~F.array_contains(F.col("gone"), x))
    return t.select("id", F.coalesce("explicit", edited).alias("items"))


@query("SELECT page_id, list_sort(list_intersect(list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1)), ['a', 'article', 'nav', 'table'])) AS tags FROM pages")
def attribute_intersection(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_sort(F.array_intersect(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1)), F.array(*map(F.lit, ("a", "article", "nav", "table"))))).alias("tags"))


@query("SELECT c_custkey, c_name, coalesce(n_name, '?') AS nation, coalesce(cnt, 0) AS orders, coalesce(total, 0.0) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def assembled_records(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return rows.select("c_custkey", "c_name", F.coalesce("n_name", F.lit("?")).alias("nation"), F.coalesce("cnt", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT * FROM (VALUES ('A', 'P'), ('B', 'P'), ('C', 'P'), ('X', 'X'), ('Y', 'Y')) v(role, resolved)")
def role_resolution(spark, d):
    """Roles followed through a map until they stand; a cycle leaves the role as it is."""
    spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "P"), ("X", "Y"), ("Y", "X")], "role string, to_role string").createOrReplaceTempView("lakeloom_roles")
    return spark.sql("""
WITH RECURSIVE walk AS (
  SELECT role, to_role AS at, array(role) AS seen FROM lakeloom_roles
  UNION ALL
  SELECT w.role, r.to_role, array_append(w.seen, w.at) FROM walk w JOIN lakeloom_roles r ON w.at = r.role WHERE NOT array_contains(w.seen, w.at)
)
SELECT b.role, coalesce(max(CASE WHEN r.role IS NULL THEN w.at END), b.role) AS resolved
FROM lakeloom_roles b JOIN walk w ON b.role = w.role LEFT JOIN lakeloom_roles r ON w.at = r.role GROUP BY b.role""")


@query("WITH RECURSIVE n AS (SELECT event_id AS node, event_id // 2 AS parent, value FROM events WHERE event_id > 0), r AS (SELECT node, value AS total FROM n WHERE node = 1 UNION ALL SELECT n.node, r.total + n.value FROM r JOIN n ON n.parent = r.node AND n.node > 1) SELECT node, round(total, 4) AS total FROM r")
def chained_offsets(spark, d):
    """Each node's value added to those of all its ancestors; node 0 is outside the tree."""
    n = table(spark, d, "events").where("event_id > 0")
    parent = F.when(F.col("event_id") > 1, F.floor(F.col("event_id") / 2))
    return graph.chain_sums(n.select(F.col("event_id").alias("node"), parent.alias("parent"), "value")).select("node", F.round("total", 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 8 = 0 AND l_linenumber % 2 = 0")
def thinned(spark, d):
    """Every eighth row and every second column of a grid."""
    return table(spark, d, "lineitem").where((F.col("l_orderkey") % 8 == 0) & (F.col("l_linenumber") % 2 == 0)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def not_yet_shown(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("WITH c AS (SELECT l_orderkey AS t, l_linenumber AS row, l_returnflag = 'R' AS blank FROM lineitem), f AS (SELECT t, min(row) AS first FROM c GROUP BY t), a AS (SELECT c.t, count(DISTINCT row) AS rows, count(*) AS cells, count(*) FILTER (blank AND row = first) AS head_blanks, count(*) FILTER (blank AND row > first) AS body_blanks FROM c JOIN f USING (t) GROUP BY c.t) SELECT t, rows, (head_blanks = 0 AND body_blanks >= greatest(2, rows)) AS has_head, (rows >= 2 AND cells >= 4) AS plausible FROM a")
def table_heads(spark, d):
    """A first row without blanks over a body of many is a head; a grid of two rows and four cells is a table."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row"), (F.col("l_returnflag") == "R").alias("blank"))
    c = c.withColumn("first", F.min("row").over(Window.partitionBy("t")))
    a = c.groupBy("t").agg(F.count_distinct("row").alias("rows"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col("blank") & (F.col("row") == F.col("first"))).alias("head_blanks"), F.count_if(F.col("blank") & (F.col("row") > F.col("first"))).alias("body_blanks"))
    return a.select("t", "rows", ((F.col("head_blanks") == 0) & (F.col("body_blanks") >= F.greatest(F.lit(2), F.col("rows")))).alias("has_head"), ((F.col("rows") >= 2) & (F.col("cells") >= 4)).alias("plausible"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), F.coalesce(F.parse_url(u, F.lit("PATH")), F.lit("")).alias("path"))


@query("SELECT * FROM (VALUES ('WIP on main: abc1234 msg', 'main', 'msg', true), ('On topic: my note', 'topic', 'my note', false)) v(said, branch, note, automatic)")
def stash_messages(spark, d):
    rows = spark.createDataFrame([("WIP on main: abc1234 msg",), ("On topic: my note",)], "said string")
    wip = F.col("said").startswith("WIP on ")
    return rows.select("said", F.regexp_extract("said", r"^(?:WIP on|On) ([^:]+):", 1).alias("branch"), F.when(wip, F.regexp_extract("said", r": [0-9a-f]+ (.*)$", 1)).otherwise(F.regexp_extract("said", r": (.*)$", 1)).alias("note"), wip.alias("automatic"))


@F.pandas_udf(T.StringType())
def fraction(value: pd.Series, most: pd.Series) -> pd.Series:
    """The nearest fraction of a bounded denominator, whole part apart."""

    def shown(v: float, m: int) -> str:
        f = Fraction(abs(v)).limit_denominator(m)
        whole, rest = divmod(f.numerator, f.denominator)
        text = f"{whole}" if not rest else f"{rest}/{f.denominator}" if not whole else f"{whole} {rest}/{f.denominator}"
        return ("-" if v < 0 and f else "") + text

    return pd.Series([None if v is None or v != v else shown(v, int(m)) for v, m in zip(value, most, strict=True)])


@query("SELECT * FROM (VALUES (1.75::DOUBLE, '1 3/4'), (3.14159::DOUBLE, '3 14/99'), (-0.5::DOUBLE, '-1/2'), (2.0::DOUBLE, '2')) v(value, shown)")
def fractions(spark, d):
    rows = spark.createDataFrame([(1.75, 9), (3.14159, 99), (-0.5, 9), (2.0, 9)], "value double, most int")
    return rows.select("value", fraction("value", "most").alias("shown"))


@query("SELECT * FROM (VALUES ([1.0::DOUBLE, 2.0, 3.0, 4.0], [7.0::DOUBLE, 10.0, 15.0, 22.0])) v(m, squared)")
def matrix_product(spark, d):
    """Two-by-two matrices as rows of four numbers, multiplied."""
    rows = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "m array<double>")
    cell = lambda i, j: F.col("m")[i * 2] * F.col("m")[j] + F.col("m")[i * 2 + 1] * F.col("m")[2 + j]
    return rows.select("m", F.array(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1)).alias("squared"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 12 + 1)::VARCHAR ELSE (o_orderkey % 12 + 1) || ' of ' || 12 END AS track, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '+0.3 EV' ELSE '-0.7 EV' END AS bias FROM orders")
def wording(spark, d):
    k = F.col("o_orderkey")
    n = (k % 12 + 1).cast("string")
    return table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, n).otherwise(F.concat(n, F.lit(" of 12"))).alias("track"), F.when(k % 3 == 0, "").when(k % 3 == 1, "+0.3 EV").otherwise("-0.7 EV").alias("bias"))


@query("SELECT l_orderkey, sum(round(l_extendedprice * (1 - l_discount), 4)::DECIMAL(18, 4))::DOUBLE AS placed, count(*) AS parts FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1")
def placed_totals(spark, d):
    p = table(spark, d, "part").where("p_size > 10")
    rows = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")).cast("double").alias("placed"), F.count(F.lit(1)).alias("parts"))
