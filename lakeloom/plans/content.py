"""Duplicates, reconciliation and trees over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.operators import duplicates, reconcile as rec, trees
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table

DOC_PATH = "concat(source, '/', doc_id)"


@query("""SELECT sha256(text) AS set_id, strlen(text)::BIGINT AS size, count(*) AS copies, (strlen(text) * (count(*) - 1))::BIGINT AS wasted, min(source || '/' || doc_id) AS first_path
FROM documents WHERE strlen(text) >= 1024 GROUP BY text HAVING count(*) > 1""")
def duplicate_sets(spark, d):
    return duplicates.duplicate_sets(table(spark, d, "documents").withColumn("path", F.expr(DOC_PATH)), "path", "text")


@query("""WITH s AS (SELECT text, count(*) AS n FROM documents WHERE strlen(text) >= 1024 GROUP BY text HAVING count(*) > 1)
SELECT sha256(text) AS set_id, strlen(text)::BIGINT AS size, n AS copies, (strlen(text) * (n - 1))::BIGINT AS wasted, source || '/' || doc_id AS path FROM documents JOIN s USING (text)""")
def duplicate_members(spark, d):
    return duplicates.duplicate_members(table(spark, d, "documents").withColumn("path", F.expr(DOC_PATH)), "path", "text")


@query("""WITH s AS (SELECT strlen(text) * (count(*) - 1) AS w FROM documents WHERE strlen(text) >= 1024 GROUP BY text HAVING count(*) > 1)
SELECT (SELECT count(*) FROM documents) AS seen, (SELECT sum(strlen(text)) FROM documents)::BIGINT AS bytes, (SELECT count(*) FROM s) AS sets, (SELECT coalesce(sum(w), 0) FROM s)::BIGINT AS wasted""")
def duplicate_totals(spark, d):
    return duplicates.duplicate_totals(table(spark, d, "documents").withColumn("path", F.expr(DOC_PATH)), "path", "text")


_SIDES = """l AS (SELECT source || '/' || doc_id AS path, strlen(text)::BIGINT AS size, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS modified, text FROM documents WHERE doc_id % 7 <> 0),
r AS (SELECT source || '/' || doc_id AS path, (strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END)::BIGINT AS size, TIMESTAMP '2024-01-01' + to_seconds(doc_id + doc_id % 5) AS modified, CASE WHEN doc_id % 13 = 0 THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0)"""


def _sides(spark, d):
    """Two versions of the documents as trees: some paths on one side only, some sizes and times moved."""
    docs = table(spark, d, "documents")
    at = lambda s: F.timestamp_seconds(F.lit(1704067200) + s).cast("timestamp_ntz")
    size = F.octet_length("text").cast("long")
    left = docs.where("doc_id % 7 <> 0").select(F.expr(DOC_PATH).alias("path"), size.alias("size"), at(F.col("doc_id")).alias("modified"), F.sha2("text", 256).alias("digest"))
    other = F.when(F.col("doc_id") % 13 == 0, F.upper("text")).otherwise(F.col("text"))
    right = docs.where("doc_id % 5 <> 0").select(F.expr(DOC_PATH).alias("path"), (size + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("size"), at(F.col("doc_id") + F.col("doc_id") % 5).alias("modified"), F.sha2(other, 256).alias("digest"))
    return left, right


def _reconciled(same: str, hide: bool) -> str:
    state = f"CASE WHEN r.path IS NULL THEN '<' WHEN l.path IS NULL THEN '>' WHEN l.size <> r.size THEN '≠' WHEN {same} THEN '=' ELSE '≠' END"
    return f"""WITH {_SIDES}, j AS (SELECT {state} AS state, coalesce(l.path, r.path) AS path, l.size AS left_size, l.modified AS left_modified, r.size AS right_size, r.modified AS right_modified
FROM l FULL OUTER JOIN r ON l.path = r.path) SELECT * FROM j {"WHERE state <> '='" if hide else ''}"""


_NEAR = "abs(epoch_us(l.modified) - epoch_us(r.modified)) <= 2000000"


@query(_reconciled(_NEAR, True))
def reconcile_rows(spark, d):
    return rec.reconcile(*_sides(spark, d))


@query(_reconciled(_NEAR, False))
def reconcile_with_slack(spark, d):
    return rec.reconcile(*_sides(spark, d), slack=2, hide_equal=False)


@query(_reconciled("l.text = r.text", True))
def reconcile_by_content(spark, d):
    return rec.reconcile(*_sides(spark, d), by_content=True)


@query(f"WITH j AS ({_reconciled(_NEAR, False)}) SELECT count(*) FILTER (state = '<') AS only_left, count(*) FILTER (state = '>') AS only_right, count(*) FILTER (state = '≠') AS different, count(*) FILTER (state = '=') AS equal FROM j")
def reconcile_counts(spark, d):
    return rec.state_counts(rec.reconcile(*_sides(spark, d), hide_equal=False))


@query("WITH l AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0), r AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0) SELECT * FROM l UNION SELECT * FROM r")
def union_of_keys(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("doc_id % 2 = 0").select("source", "lang").union(docs.where("doc_id % 3 = 0").select("source", "lang")).distinct()


PAGE_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.expr("regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')").alias("path"), F.octet_length("html").cast("long").alias("size"))


_P = f"p AS (SELECT page_id, {PAGE_PATH} AS path, strlen(html)::BIGINT AS size FROM pages), s AS (SELECT page_id, path, size, string_split(path, '/') AS parts FROM p)"
_ROLL = f"{_P}, a AS (SELECT size, unnest(list_transform(range(0, len(parts) + 1), lambda k: array_to_string(parts[1:k], '/'))) AS node FROM s), n AS (SELECT node, CASE WHEN node = '' THEN NULL ELSE regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent, CASE WHEN node = '' THEN 0 ELSE len(string_split(node, '/')) END::INT AS depth, sum(size)::BIGINT AS size, count(*) AS files FROM a GROUP BY node)"


@query(f"WITH {_ROLL} SELECT * FROM n")
def tree_rollup(spark, d):
    return trees.rollup(_pages(spark, d))


def _top_rest_sql(n: int) -> str:
    return f"""WITH {_ROLL}, k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY size DESC, node) AS rank FROM n WHERE size > 0 AND parent IS NOT NULL),
r1 AS (SELECT * FROM k WHERE parent = ''), r2 AS (SELECT k.* FROM k JOIN (SELECT node FROM r1 WHERE rank <= {n}) x ON k.parent = x.node), r3 AS (SELECT k.* FROM k JOIN (SELECT node FROM r2 WHERE rank <= {n}) x ON k.parent = x.node),
shown AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT parent, node AS label, size, rank::INT AS rank, false AS is_rest FROM shown WHERE rank <= {n}
UNION ALL SELECT parent, count(*) || ' more', sum(size)::BIGINT, {n + 1}, true FROM shown WHERE rank > {n} GROUP BY parent"""


@query(_top_rest_sql(12))
def tree_top_rest(spark, d):
    return trees.top_rest(trees.rollup(_pages(spark, d)))


@query(_top_rest_sql(3))
def tree_top_rest_3(spark, d):
    return trees.top_rest(trees.rollup(_pages(spark, d)), slices=3)


_MARKS = f"{_P}, m AS (SELECT DISTINCT array_to_string(parts[1:1 + (page_id % 3)::INT], '/') AS path FROM s WHERE page_id % 2 = 0)"


def _marks(spark, d):
    return _pages(spark, d).where("page_id % 2 = 0").select(F.expr("array_join(slice(split(path, '/'), 1, 1 + cast(page_id % 3 as int)), '/')").alias("path")).distinct()


@query(f"WITH {_MARKS} SELECT path FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.path <> m.path AND starts_with(m.path, b.path || '/'))")
def tree_topmost_marks(spark, d):
    return trees.topmost(_marks(spark, d))


@query(f"WITH {_MARKS}, q AS (SELECT DISTINCT path FROM p) SELECT q.path, (SELECT max_by(m.path, length(m.path)) FROM m WHERE q.path = m.path OR starts_with(q.path, m.path || '/')) AS marked FROM q")
def nearest_marked(spark, d):
    return trees.nearest_marked(_pages(spark, d), _marks(spark, d))


@query(f"WITH {_P}, t AS (SELECT size, path[length('docs/') + 1:] AS tail FROM (SELECT 'docs/' || path AS path, size FROM p)) SELECT string_split(tail, '/')[1] AS name, max(contains(tail, '/')) AS is_folder, sum(size)::BIGINT AS size, count(*) AS files FROM t WHERE tail <> '' GROUP BY 1")
def immediate_children(spark, d):
    return trees.children(_pages(spark, d).withColumn("path", F.concat(F.lit("docs/"), "path")), "docs/")


@query(f"WITH {_P} SELECT DISTINCT array_to_string(parts[1:k], '/') AS folder, k::INT AS depth FROM s, unnest(range(1, len(parts))) AS t(k)")
def implied_folders(spark, d):
    return trees.implied_folders(_pages(spark, d))


_NAMES = "('a/b'), ('/etc/x'), ('C:/x'), ('a/../b'), ('..'), ('.git/x'), ('x/.y/z'), ('./a/b/'), ('a..b/c'), ('ok\\x')"


@query(f"""SELECT name, (starts_with(replace(name, '\\', '/'), '/') OR substr(name, 2, 1) = ':' OR list_contains(string_split(replace(name, '\\', '/'), '/'), '..')) AS dangerous,
regexp_replace(regexp_replace(replace(name, '\\', '/'), '^(?:\\./|/)+', ''), '/+$', '') AS clean,
len(list_filter(string_split(name, '/'), lambda s: starts_with(s, '.') AND s NOT IN ('.', '..'))) > 0 AS hidden
FROM (SELECT * FROM (VALUES {_NAMES}) v(name) UNION ALL SELECT {PAGE_PATH} FROM pages)""")
def path_safety(spark, d):
    names = spark.createDataFrame([(n,) for n in ("a/b", "/etc/x", "C:/x", "a/../b", "..", ".git/x", "x/.y/z", "./a/b/", "a..b/c", "ok\\x")], "name string")
    names = names.unionByName(_pages(spark, d).select(F.col("path").alias("name")))
    n = F.col("name")
    return names.select("name", tx.is_dangerous(n).alias("dangerous"), tx.normalised(n).alias("clean"), tx.is_hidden(n).alias("hidden"))


@query("SELECT doc_id, CASE WHEN starts_with(source || '/' || doc_id, 'src1/') THEN 'moved' || substr(source || '/' || doc_id, 5) ELSE source || '/' || doc_id END AS path FROM documents WHERE source <> 'src2'")
def rename_under_prefix(spark, d):
    rows = table(spark, d, "documents").where("source <> 'src2'")
    return rows.select("doc_id", tx.renamed(F.expr(DOC_PATH), "src1", "moved").alias("path"))


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS stored, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source")
def archive_totals(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).alias("stored"), F.sum(F.length("text")).alias("characters"))


# Line furniture: a "page" is a document, a "document" of pages is its source.
_LINES = "WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), f AS (SELECT source, line, count(DISTINCT doc_id) AS found FROM l WHERE line <> '' AND length(line) <= 120 GROUP BY source, line), k AS (SELECT f.* FROM f JOIN n USING (source) WHERE pages >= 3 AND found >= greatest(3, CAST(floor(pages * 0.05) AS INT)))"


def _furniture(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    pages = docs.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    short = lines.where("line <> '' AND length(line) <= 120").select("source", "doc_id", "line").distinct()
    found = short.groupBy("source", "line").agg(F.count(F.lit(1)).alias("found")).join(pages, "source")
    return lines, found.where("pages >= 3 AND found >= greatest(3, cast(floor(pages * 0.05) as int))").select("source", "line", "found")


@query(f"{_LINES} SELECT source, line, found FROM k")
def line_furniture(spark, d):
    return _furniture(spark, d)[1]


@query(f"{_LINES} SELECT l.source, count(*) AS kept FROM l LEFT JOIN k ON l.source = k.source AND l.line = k.line WHERE k.line IS NULL GROUP BY l.source")
def repeat_removal(spark, d):
    lines, furniture = _furniture(spark, d)
    return lines.join(furniture, ["source", "line"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
