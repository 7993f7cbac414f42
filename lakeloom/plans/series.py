"""Windows, islands, as-of lookups and range joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators import ranges, timeline
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table

_T = "epoch_us(ts) / 1000000.0"


def _events(spark, d):
    return table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0))


_PROBES = f"p AS (SELECT event_id, user_id, {_T} AS t FROM events WHERE event_type = 'click'), k AS (SELECT user_id, {_T} AS t, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def _probes(spark, d):
    e = _events(spark, d)
    return e.where("event_type = 'click'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select("user_id", "t", F.col("value").alias("v"))


@query(f"WITH {_PROBES} SELECT p.event_id, coalesce(k.v, (SELECT arg_min(f.v, f.t) FROM k f WHERE f.user_id = p.user_id)) AS found FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.t >= k.t")
def asof_hold(spark, d):
    probes, keys = _probes(spark, d)
    return timeline.as_of(probes, keys, "user_id", "t", "v").select("event_id", "found")


@query(f"""WITH {_PROBES}, l AS (SELECT p.*, k.t AS t0, k.v AS v0 FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.t >= k.t), b AS (SELECT l.*, k.t AS t1, k.v AS v1 FROM l ASOF LEFT JOIN k ON l.user_id = k.user_id AND l.t <= k.t)
SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS found FROM b""")
def asof_linear(spark, d):
    probes, keys = _probes(spark, d)
    return timeline.as_of(probes, keys, "user_id", "t", "v", "linear").select("event_id", F.round("found", 6).alias("found"))


@query(f"WITH e AS (SELECT event_id, user_id, {_T} AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), i AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT user_id, island::BIGINT AS island, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM i GROUP BY ALL")
def gap_islands(spark, d):
    rows = timeline.islands(_events(spark, d).select("event_id", "user_id", "t"), "user_id", "t", 86400)
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@query("""WITH c AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM conversations),
l AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, coalesce(g, 0) ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS asked FROM c) SELECT conv_id, turn, asked FROM l WHERE role = 'assistant'""")
def carry_forward(spark, d):
    """The last user text before each assistant turn, used once."""
    line = Window.partitionBy("conv_id").orderBy("turn", "role")
    g = F.coalesce(F.count_if(F.col("role") == "assistant").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table(spark, d, "conversations").withColumn("g", g)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), True).over(Window.partitionBy("conv_id", "g").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("asked", asked).where("role = 'assistant'").select("conv_id", "turn", "asked")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) SELECT l_orderkey, rank::INT AS rank, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 9) AS share FROM r WHERE rank <= 4")
def top4_share(spark, d):
    rows = table(spark, d, "lineitem").withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return timeline.top_shares(rows, "l_orderkey", "l_extendedprice", "tie").select("l_orderkey", "rank", F.round("share", 9).alias("share"))


@query("WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal - 500 AS lo, s_acctbal + 500 AS hi FROM supplier) SELECT c_custkey, s_suppkey FROM customer JOIN b ON c_nationkey = s_nationkey AND c_acctbal BETWEEN lo AND hi")
def containment(spark, d):
    boxes = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 500).alias("lo"), (F.col("s_acctbal") + 500).alias("hi"))
    points = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"))
    return ranges.containment(points, boxes, "nation", "at", "lo", "hi", 1000.0).select("c_custkey", "s_suppkey")


@query("WITH g AS (SELECT c_nationkey AS nation, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS gap FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY nation) AS n FROM g WHERE gap IS NOT NULL) SELECT nation, round(gap, 6) AS quartile FROM r WHERE k = n // 4")
def nearest_gap_quartile(spark, d):
    line = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    gaps = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") - F.lag("c_acctbal").over(line)).alias("gap")).where("gap IS NOT NULL")
    by = Window.partitionBy("nation")
    rows = gaps.withColumn("k", F.row_number().over(by.orderBy("gap")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    return rows.where(F.col("k") == F.floor(F.col("n") / 4)).select("nation", F.round("gap", 6).alias("quartile"))


@query("WITH v AS (SELECT s_nationkey, list_sort(list(s_acctbal)) AS v FROM supplier GROUP BY 1) SELECT s_nationkey, unnest(list_reduce(v, lambda out, x: CASE WHEN len(out) = 0 OR x - out[-1] > 100 THEN list_append(out, x) ELSE out END, []::DOUBLE[])) AS kept FROM v")
def merge_near(spark, d):
    """Values kept of each tolerance chain, each compared with the last that was kept."""
    return ranges.chains_merged(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", 100.0)


@query("WITH n AS (SELECT part.*, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, CASE WHEN k = 1 THEN p_type ELSE p_type || ' (' || k || ')' END AS unique_name FROM n")
def collision_suffix(spark, d):
    return timeline.numbered_names(table(spark, d, "part").withColumn("by", F.col("p_brand")), "by", "p_type", "p_partkey").select("p_partkey", "unique_name")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), w AS (SELECT doc_id, i, len(string_split(line, ' ')) // 20 AS w FROM l), f AS (SELECT *, CASE WHEN w IS DISTINCT FROM lag(w) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS s FROM w), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT doc_id, run::BIGINT AS run, count(*) AS lines FROM g GROUP BY doc_id, run HAVING count(*) > 1")
def row_runs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("w", F.floor(F.size(F.split("line", " ")) / 20))
    line = Window.partitionBy("doc_id").orderBy("i")
    rows = rows.withColumn("s", F.when(~F.col("w").eqNullSafe(F.lag("w").over(line)) | (F.col("i") == 0), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")


@query("SELECT event_id, (sum(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS byte FROM events")
def delta_decode(spark, d):
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.pmod(F.sum(F.floor("value")).over(line), F.lit(256)).alias("byte"))


@query("SELECT o_orderkey, (sum(floor(o_totalprice)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS before FROM orders")
def stacking_offsets(spark, d):
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "orders").select("o_orderkey", F.sum(F.floor("o_totalprice")).over(line).alias("before"))
