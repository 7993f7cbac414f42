"""Rules of pages, names, numbers and lists over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.functions import numbers as nm, text as tx
from lakeloom.operators import graph, pagelayout as pl, ranges, timeline, trees
from lakeloom.operators.rounds import shared_folder
from lakeloom.plans.registry import query
from lakeloom.sources import binary
from lakeloom.sources.tables import table


@query("SELECT p_partkey, lpad((p_partkey % 120)::VARCHAR, greatest(2, length((p_partkey % 120)::VARCHAR))::INT, '0') || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'f-' || p_partkey WHEN p_partkey % 3 = 1 THEN p_name || '- - ' || p_type ELSE 'track' END || '.mp3' AS name FROM part")
def track_names(spark, d):
    """Names of tracks, of which some have no title and some one that file names cannot hold."""
    k = F.col("p_partkey")
    title = F.when(k % 3 == 1, F.concat("p_name", F.lit("/  : "), F.col("p_type"))).when(k % 3 == 2, "  ").otherwise("")
    target = F.when(k % 2 == 0, F.concat(F.lit("https://h/a/f-"), k.cast("string"), F.lit(".mp3?q=1"))).otherwise(F.concat(F.lit("C:\\m\\f-"), k.cast("string"), F.lit(".mp3")))
    return table(spark, d, "part").select("p_partkey", tx.track_name(k % 120, title, target).alias("name"))


@query("SELECT doc_id, doc_id % 7 = 0 AS is_binary FROM documents")
def binary_sniff(spark, d):
    """Contents of which every seventh has a zero byte near its start."""
    data = F.concat(F.lit(b"head"), F.when(F.col("doc_id") % 7 == 0, F.lit(b"\x00")).otherwise(F.lit(b" ")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return table(spark, d, "documents").select("doc_id", tx.is_binary(data).alias("is_binary"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AND (o_orderkey % 100 < 10 OR o_orderkey % 100 > 90) AS at_edge, o_orderkey % 3 = 0 AS lone FROM orders")
def page_numbers(spark, d):
    """Lines that are only a number, at the edge of a page or anywhere."""
    k = F.col("o_orderkey")
    n = (k % 10000).cast("string")
    line = F.when(k % 3 == 0, F.when(k % 2 == 0, F.concat(F.lit("- "), n, F.lit(" -"))).otherwise(F.concat(F.lit("p. "), n, F.lit("/99")))).when(k % 3 == 1, F.concat(n, F.lit(" pages"))).otherwise(F.concat(F.lit("chapter "), n))
    return table(spark, d, "orders").select("o_orderkey", pl.number_at_edge(line, (k % 100) / 100).alias("at_edge"), pl.number_alone(line).alias("lone"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, max(l_quantity) OVER (PARTITION BY l_orderkey) AS most FROM lineitem), n AS (SELECT *, count(*) FILTER (l_quantity < 0.95 * most) OVER (PARTITION BY l_orderkey) AS inside FROM w) SELECT l_orderkey, l_linenumber, l_quantity FROM n WHERE inside < 2 OR l_quantity < 0.95 * most")
def frames_removed(spark, d):
    return pl.without_frames(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity")


_RUNS = """r AS (SELECT o_custkey AS line, o_orderkey AS id, o_orderkey * 10.0::DOUBLE AS x0, o_orderkey * 10.0 + CASE o_orderkey % 3 WHEN 0 THEN 9.0 ELSE 4.0 END AS x1, CASE WHEN o_orderkey % 2 = 0 THEN 8.0 ELSE 12.0 END AS size, 'w' || o_orderkey AS text FROM orders),
g AS (SELECT *, x0 - lag(x1) OVER w AS gap, least(size, lag(size) OVER w) AS unit FROM r WINDOW w AS (PARTITION BY line ORDER BY x0))"""


def _runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("line"), k.alias("id"), (k * 10.0).alias("x0"), (k * 10.0 + F.when(k % 3 == 0, 9.0).otherwise(4.0)).alias("x1"), F.when(k % 2 == 0, 8.0).otherwise(12.0).alias("size"), F.concat(F.lit("w"), k.cast("string")).alias("text"))


@query(f"WITH {_RUNS} SELECT line, string_agg(CASE WHEN gap > unit * 0.18 THEN ' ' ELSE '' END || text, '' ORDER BY x0) AS text FROM g GROUP BY line")
def word_gaps(spark, d):
    return pl.line_texts(_runs(spark, d), "line", "x0", "x1", "size", "text")


@query(f"WITH {_RUNS} SELECT line, id, (sum(CASE WHEN gap > unit * 2.2 THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY x0 ROWS UNBOUNDED PRECEDING))::INT AS cell FROM g")
def column_cells(spark, d):
    return pl.cells(_runs(spark, d), "line", "x0", "x1", "size").select("line", "id", "cell")


@query("""WITH l AS (SELECT user_id AS page, event_id AS place, CASE WHEN event_id % 5 < 2 THEN 'left' WHEN event_id % 7 = 0 THEN 'right' END AS side FROM events),
n AS (SELECT *, CASE WHEN side IS NOT DISTINCT FROM lag(side) OVER (PARTITION BY page ORDER BY place) AND row_number() OVER (PARTITION BY page ORDER BY place) > 1 THEN 0 ELSE 1 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM n), c AS (SELECT page, run, any_value(side) AS side, count(*) AS n FROM r GROUP BY page, run)
SELECT page, coalesce(sum(n) FILTER (side = 'left'), 0) > 0 AND coalesce(sum(n) FILTER (side = 'right'), 0) > 0 AND coalesce(max(n) FILTER (side IS NOT NULL), 0) >= 2 AND coalesce(sum(n) FILTER (side IS NOT NULL), 0) >= 0.25 * sum(n) AS columns FROM c GROUP BY page""")
def column_pages(spark, d):
    """Pages whose lines stand alone on either side."""
    k = F.col("event_id")
    left, right = k % 5 < 2, (k % 7 == 0) & (k % 5 >= 2)
    both = ~left & ~right
    lines = table(spark, d, "events").select(F.col("user_id").alias("page"), k.alias("at"), (left | both).alias("l"), (right | both).alias("r"))
    return pl.in_columns(lines, "page", "at", "l", "r")


@query("""WITH p AS (SELECT o_custkey AS element, o_orderkey AS place, (o_orderkey % 40)::DOUBLE AS y, CASE WHEN o_orderkey % 9 = 0 THEN 20.0 ELSE 10.0 END AS size, CASE WHEN o_orderkey % 9 = 0 THEN 'A' ELSE 'w' || o_orderkey END AS text FROM orders),
b AS (SELECT *, abs(y - lag(y) OVER w) > greatest(1.0, 0.5 * least(size, lag(size) OVER w)) AND NOT (lag(size) OVER w >= 1.5 * size AND length(lag(text) OVER w) = 1) AS breaks FROM p WINDOW w AS (PARTITION BY element ORDER BY place))
SELECT element, string_agg(CASE WHEN breaks THEN chr(10) ELSE '' END || text, '' ORDER BY place) AS text FROM b GROUP BY element""")
def tagged_breaks(spark, d):
    k = F.col("o_orderkey")
    pieces = table(spark, d, "orders").select(F.col("o_custkey").alias("element"), k.alias("at"), (k % 40).cast("double").alias("y"), F.when(k % 9 == 0, 20.0).otherwise(10.0).alias("size"), F.when(k % 9 == 0, "A").otherwise(F.concat(F.lit("w"), k.cast("string"))).alias("text"))
    return pl.with_breaks(pieces, "element", "at", "y", "size", "text")


@query("""WITH s AS (SELECT o_custkey AS p, o_orderkey AS place, 'w_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END AS t, CASE o_orderkey % 4 WHEN 0 THEN '**' WHEN 1 THEN '' WHEN 2 THEN '***' ELSE '~~' END AS m FROM orders),
n AS (SELECT *, CASE WHEN m = lag(m) OVER (PARTITION BY p ORDER BY place) THEN 0 ELSE 1 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM n),
g AS (SELECT p, run, m, string_agg(t, '' ORDER BY place) AS t FROM r GROUP BY p, run, m)
SELECT p, trim(string_agg(m || replace(rtrim(t), '_', '\\_') || m || CASE WHEN t LIKE '% ' THEN ' ' ELSE '' END, '' ORDER BY run)) AS markdown FROM g GROUP BY p""")
def merged_spans(spark, d):
    k = F.col("o_orderkey")
    spans = table(spark, d, "orders").select(F.col("o_custkey").alias("p"), k.alias("at"), F.concat(F.lit("w_"), k.cast("string"), F.when(k % 2 == 0, " ").otherwise("")).alias("t"), (k % 2 == 0).alias("b"), (k % 4 == 2).alias("i"), (k % 4 == 3).alias("s"))
    return pl.marked_spans(spans, "p", "at", "t", "b", "i", "s")


@query("""WITH p AS (SELECT user_id AS doc, event_id AS pos, (event_id % 3 = 0)::INT AS level FROM events),
t AS (SELECT *, sum(1 - level) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS tops FROM p), u AS (SELECT *, sum(level) OVER (PARTITION BY doc, tops ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subs FROM t)
SELECT doc, pos, CASE WHEN level = 0 THEN (tops + 4) || '.' ELSE (CASE WHEN tops = 0 THEN 4 ELSE tops + 4 END) || '.' || subs || ')' END AS label FROM u""")
def list_numbering(spark, d):
    """Numbers of two levels, the first from five on; the second shows both."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.lit("n").alias("list_id"), (F.col("event_id") % 3 == 0).cast("int").alias("level"))
    return pl.list_labels(rows, {"a": {0: ("decimal", "%1.", 1, False), 1: ("lowerRoman", "%1.%2)", 1, True)}}, {"n": ("a", {0: 5})}).select("doc", "pos", "label")


@query("SELECT event_id, CASE WHEN value <= 0 THEN 0 WHEN 2 * value / 100 >= 1 THEN 255 ELSE floor((CASE WHEN value / 50 <= 0.0031308 THEN 12.92 * value / 50 ELSE 1.055 * pow(value / 50, 1 / 2.4) - 0.055 END) * 255 + 0.5)::INT END AS shown, round((0.6 * value * (2.51 * 0.6 * value + 0.03)) / (0.6 * value * (2.43 * 0.6 * value + 0.59) + 0.14), 9) AS film, CASE WHEN value < 0 THEN '-' ELSE '' END || regexp_replace(regexp_replace(round(abs(value), 4)::DECIMAL(20, 4)::VARCHAR, '0+$', ''), '\\.$', '') AS said FROM events")
def light_curves(spark, d):
    """Light at one stop more, a film's shoulder, and numbers as text."""
    v = F.col("value")
    return table(spark, d, "events").select("event_id", nm.displayed(v / 100, 1.0).alias("shown"), F.round(nm.filmic(v), 9).alias("film"), tx.trimmed_number(v).alias("said"))


@query("SELECT p_partkey, (p_partkey + 1)::DOUBLE AS rate, (p_partkey % 128) + 128 * (p_partkey % 100) AS size, '#' || lower(lpad(hex(p_size % 256), 2, '0')) || 'ff00' AS colour FROM part")
def packed_fields(spark, d):
    """Extended-precision numbers, sizes of seven bits a byte, and colours."""
    n = F.col("p_partkey") + 1
    power = F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")
    head = F.lpad(F.hex((power + 16383).cast("long")), 4, "0")
    mantissa = F.lpad(F.hex((n * F.pow(F.lit(2.0), F.lit(31) - power)).cast("long")), 8, "0")
    byte = lambda x: x.cast("int")
    rows = table(spark, d, "part")
    return rows.select(
        "p_partkey", nm.extended(F.unhex(F.concat(head, mantissa, F.lit("00000000")))).alias("rate"),
        nm.synchsafe(F.lit(0), F.lit(0), byte(F.col("p_partkey") % 100), byte(F.col("p_partkey") % 128)).cast("long").alias("size"), nm.hex_colour((F.col("p_size") % 256) / 255.0, F.lit(1.0), F.lit(0.0)).alias("colour"),
    )


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\\p{L})-\\s*\\n\\s*(\\p{Ll})', '\\1\\2', 'g'), '(\\p{L})-\\s*\\n\\s*(\\p{L})', '\\1-\\2', 'g'), '[\\r\\n\\t]+', ' ', 'g'), ' {2,}', ' ', 'g'), ' ') AS tidy, replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') AS cell FROM documents")
def tidy_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tidied(F.col("text")).alias("tidy"), tx.table_cell(F.col("text")).alias("cell"))


@query("""WITH k AS (SELECT user_id, event_id AS t, max(value) AS v FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2), n AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2, first_value(v) OVER w AS head FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t)),
h AS (SELECT user_id, min(t) AS t0, arg_min(v, t) AS v0 FROM k GROUP BY 1), p AS (SELECT user_id, event_id FROM events WHERE event_id % 4 <> 0),
j AS (SELECT p.user_id, event_id, n.t, n.v, n.t2, n.v2, (event_id - n.t)::DOUBLE / (n.t2 - n.t) AS u, (n.t2 - n.t) / 10.0 AS s FROM p ASOF LEFT JOIN n ON p.user_id = n.user_id AND p.event_id >= n.t)
SELECT user_id, event_id, round(CASE WHEN j.t IS NULL THEN h.v0 WHEN t2 IS NULL THEN v ELSE (2 * u * u * u - 3 * u * u + 1) * v + (u * u * u - 2 * u * u + u) * 0.5 * s + (3 * u * u - 2 * u * u * u) * v2 + (u * u * u - u * u) * (-0.25) * s END, 4) AS found FROM j LEFT JOIN h USING (user_id)""")
def asof_curved(spark, d):
    """Values between keys on a cubic of given slopes, ten moments a second."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    keys = e.where("event_id % 4 = 0").withColumn("out", F.lit(0.5)).withColumn("into", F.lit(-0.25))
    found = timeline.as_of_curved(e.where("event_id % 4 <> 0").select("user_id", "event_id"), keys, "user_id", "event_id", "value", "out", "into", 10.0)
    return found.select("user_id", "event_id", F.round("found", 4).alias("found"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'HEAD' ELSE o_orderpriority END AS name, o_orderdate AS \"when\" FROM orders ORDER BY o_orderdate DESC, lower(name), o_orderkey LIMIT 200")
def newest_refs(spark, d):
    """References, newest first, and those of one moment whatever their case."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "HEAD").otherwise(F.col("o_orderpriority")).alias("name"), F.col("o_orderdate").alias("when"))
    return rows.orderBy(F.desc("when"), F.lower("name"), "o_orderkey").limit(200)


@query("SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: lower(trim(x)))) AS line FROM documents) WHERE line <> ''")
def keys_once_a_page(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", F.lower(F.trim("line")).alias("line")).where("line <> ''").distinct()


@query("SELECT c_custkey, round((SELECT count(DISTINCT m // 32) FROM unnest(range(0, c_custkey % 900 + 1, CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 100 END)) r(m)) * 32 * (c_custkey % 7 + 1) * 0.55, 6) AS cost FROM customer")
def decode_cost(spark, d):
    """Cost of pictures in blocks of 32 lines at two steps."""
    k = F.col("c_custkey")
    cost = nm.read_cost(k % 900 + 1, F.lit(32), F.when(k % 2 == 0, 8).otherwise(100), k % 7 + 1, F.lit(0.55))
    return table(spark, d, "customer").select("c_custkey", F.round(cost, 6).alias("cost"))


@query("WITH r AS (SELECT c_nationkey AS network, c_custkey AS id, c_acctbal / 100 AS y, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal / 100, c_custkey) AS i FROM customer) SELECT network, id, round(13.0 * i + max(y - 13.0 * i) OVER (PARTITION BY network ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS y FROM r")
def settled_nodes(spark, d):
    """Boxes of one column pushed down until none overlaps."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("network"), F.col("c_custkey").alias("id"), F.lit(0.0).alias("x"), (F.col("c_acctbal") / 100).alias("y"), F.lit(5.0).alias("height"))
    return pl.settled(rows, "network", 100.0, 8.0, 8.0).select("network", "id", F.round("y", 6).alias("y"))


@query("WITH b AS (SELECT s_suppkey, s_nationkey, s_acctbal - 900 AS x0, s_acctbal + 900 AS x1, (s_suppkey % 50) * 2.0 - 20 AS y0, (s_suppkey % 50) * 2.0 + 20 AS y1 FROM supplier) SELECT c_custkey, s_suppkey FROM customer JOIN b ON c_nationkey = s_nationkey AND c_acctbal BETWEEN x0 AND x1 AND c_custkey % 100 BETWEEN y0 AND y1")
def cover(spark, d):
    """Notes that cover nodes."""
    middle = (F.col("s_suppkey") % 50) * 2.0
    boxes = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 900).alias("x0"), (F.col("s_acctbal") + 900).alias("x1"), (middle - 20).alias("y0"), (middle + 20).alias("y1"))
    points = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return ranges.covered(points, boxes, "nation", "x", "y", "x0", "x1", "y0", "y1", 500.0).select("c_custkey", "s_suppkey")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name || p_type), 'small') THEN 'small' WHEN contains(lower(p_type), 'eco') THEN 'cheap' ELSE 'other' END AS role FROM part")
def name_roles(spark, d):
    ordered = [("ring", "ring"), ("small", "small"), ("eco", "cheap")]
    name = F.concat("p_name", F.lit(" "), "p_type")
    return table(spark, d, "part").select("p_partkey", tx.role(name, ordered).alias("role"))


@query("SELECT event_id, ['k: ' || CASE WHEN length(long) > 120 THEN left(long, 119) || '…' ELSE long END, 'n: ' || user_id] AS fields FROM (SELECT *, repeat(event_type || ' ', (event_id % 30)::INT + 1) AS long FROM events)")
def shown_fields(spark, d):
    """Scalars of an object with a long text that has breaks, a number, a list and an object."""
    long = F.repeat(F.concat("event_type", F.lit("\\n")), (F.col("event_id") % 30 + 1).cast("int"))
    document = F.concat(F.lit('{"k": "'), long, F.lit('", "skip": [1], "n": '), F.col("user_id").cast("string"), F.lit(', "o": {"a": 1}, "z": null}'))
    return table(spark, d, "events").select("event_id", tx.fields(document).alias("fields"))


@query("WITH m AS (SELECT DISTINCT source || '/' || lang AS p FROM documents WHERE lang = 'en' UNION SELECT source FROM documents WHERE source LIKE '%1%'), t AS (SELECT p FROM m WHERE NOT EXISTS (SELECT 1 FROM m n WHERE starts_with(m.p, n.p || '/'))) SELECT p AS marked, sum(n_chars)::BIGINT AS size, count(*) AS files FROM t JOIN documents ON starts_with(source || '/' || lang || '/' || doc_id, p || '/') GROUP BY p")
def marked_sizes(spark, d):
    """What the marked folders hold, a folder below a marked one not counted again."""
    docs = table(spark, d, "documents")
    entries = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"))
    marks = docs.where("lang = 'en'").select(F.concat_ws("/", "source", "lang").alias("path")).unionByName(docs.where("source LIKE '%1%'").select(F.col("source").alias("path"))).distinct()
    return trees.marked_totals(entries, marks)


@query("SELECT event_id AS node, row_number() OVER (ORDER BY -CASE WHEN event_id > 0 THEN floor(log2(event_id))::INT ELSE 0 END, ts DESC, event_id) - 1 AS position FROM events")
def commit_positions(spark, d):
    """Children before parents, the newest first among those of equal standing."""
    e = table(spark, d, "events")
    edges = e.where("event_id > 1").select(F.floor(F.col("event_id") / 2).alias("src"), F.col("event_id").alias("dst"))
    return graph.commit_order(e.select(F.col("event_id").alias("node"), F.col("ts").alias("when")), edges).select("node", "position")


@query("SELECT DISTINCT 'k=' || n_regionkey AS folder, true AS filled, true AS stopped FROM nation WHERE n_regionkey < 3")
def folder_listing(spark, d):
    """The first three of a folder's files; one with a dotted name is not seen."""
    folder = f"{shared_folder(spark)}/lakeloom-listing/{uuid.uuid4().hex}"
    table(spark, d, "nation").withColumn("k", F.col("n_regionkey")).repartition(1).write.partitionBy("k").json(folder)
    found = binary.listing(spark, folder, "*.json", limit=3)
    return found.select(F.regexp_extract("path", "^([^/]*)/", 1).alias("folder"), (F.col("length") > 0).alias("filled"), "stopped")
