"""Databases, delimited and JSON files made from the driver's tables and read back."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import functions as F

from lakeloom.operators import codepages
from lakeloom.plans.registry import query
from lakeloom.sources import binary, databases, delimited, registry
from lakeloom.sources.tables import table


def _database(rows: pd.DataFrame) -> pd.DataFrame:
    """One region and its nations as a database."""
    con = sqlite3.connect(":memory:")
    region = int(rows["n_regionkey"].iloc[0])
    con.executescript(
        "CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_note BLOB);"
        "CREATE VIEW names AS SELECT n_name FROM nation;"
        "CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY AUTOINCREMENT, n_name TEXT NOT NULL DEFAULT 'none', n_regionkey INT REFERENCES region ON DELETE CASCADE);"
        "CREATE UNIQUE INDEX by_name ON nation (n_name, n_regionkey);"
        "CREATE TRIGGER checked AFTER DELETE ON nation BEGIN SELECT 1; END;"
        f"PRAGMA user_version = {region - 2}; PRAGMA application_id = {region + 7};"
    )
    con.execute("INSERT INTO region VALUES (?, ?)", (region, b"\x89PNG\r\n\x1a\n" + bytes(region)))
    for r in rows.sort_values("n_nationkey").itertuples():
        con.execute("INSERT INTO nation VALUES (?, ?, ?)", (int(r.n_nationkey), r.n_name, region if r.n_nationkey % 2 else None))
    con.commit()
    return pd.DataFrame({"path": [f"{region}.db"], "content": [con.serialize()]})


def _databases(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(_database, "path string, content binary")


@query("SELECT n_regionkey || '.db' AS path, name, kind, seq::INT AS seq FROM (SELECT DISTINCT n_regionkey FROM nation), (VALUES ('region', 'table', 0), ('nation', 'table', 1), ('names', 'view', 2)) v(name, kind, seq)")
def sqlite_objects(spark, d):
    return binary.rows_of(_databases(spark, d), databases.objects, databases.OBJECTS).drop("failure")


@query("SELECT n_regionkey || '.db' AS path, table_name, seq::INT AS seq, name, type, required, default_value, key_seq::INT AS key_seq FROM (SELECT DISTINCT n_regionkey FROM nation), (VALUES ('region', 0, 'r_regionkey', 'INTEGER', false, NULL, 1), ('region', 1, 'r_note', 'BLOB', false, NULL, 0), ('nation', 0, 'n_nationkey', 'INTEGER', false, NULL, 1), ('nation', 1, 'n_name', 'TEXT', true, '''none''', 0), ('nation', 2, 'n_regionkey', 'INT', false, NULL, 0), ('names', 0, 'n_name', 'TEXT', false, NULL, 0)) v(table_name, seq, name, type, required, default_value, key_seq)")
def sqlite_columns(spark, d):
    return binary.rows_of(_databases(spark, d), databases.columns, databases.COLUMNS).drop("failure", "hidden")


@query("SELECT n_regionkey || '.db' AS path, 'nation' AS table_name, 'n_regionkey -> region.r_regionkey CASCADE' AS said FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT n_regionkey || '.db', 'nation', 'by_name unique: n_name, n_regionkey' FROM (SELECT DISTINCT n_regionkey FROM nation) UNION ALL SELECT n_regionkey || '.db', 'nation', 'checked' FROM (SELECT DISTINCT n_regionkey FROM nation)")
def sqlite_keys(spark, d):
    """Foreign keys, indexes and triggers, one wording each."""
    files = _databases(spark, d)
    keys = binary.rows_of(files, databases.foreign_keys, databases.KEYS).select("path", "table_name", F.concat("column_name", F.lit(" -> "), "target", F.lit("."), "target_column", F.lit(" "), "on_delete").alias("said"))
    indexed = binary.rows_of(files, databases.indexes, databases.INDEXES).select("path", "table_name", F.concat("name", F.when(F.col("is_unique"), " unique: ").otherwise(": "), "columns").alias("said"))
    return keys.unionByName(indexed).unionByName(binary.rows_of(files, databases.triggers, databases.TRIGGERS).select("path", "table_name", F.col("name").alias("said")))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation), p AS (SELECT * FROM r WHERE k BETWEEN 1 AND 3) SELECT n_regionkey || '.db' AS path, k AS row, 0 AS col, 'integer' AS kind, n_nationkey::VARCHAR AS value FROM p UNION ALL SELECT n_regionkey || '.db', k, 1, 'text', n_name FROM p UNION ALL SELECT n_regionkey || '.db', k, 2, CASE WHEN n_nationkey % 2 = 1 THEN 'integer' ELSE 'null' END, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey::VARCHAR END FROM p UNION ALL SELECT DISTINCT n_regionkey || '.db', 0, -1, 'blob', 'PNG · ' || (8 + n_regionkey) || ' B' FROM nation")
def sqlite_page(spark, d):
    """Rows 1 to 3 of a table, and the label of a blob of another."""
    files = _databases(spark, d)
    page = binary.rows_of(files, databases.page_reader("nation", 3, 1), databases.CELLS)
    blobs = binary.rows_of(files, databases.page_reader("region", 1), databases.CELLS).where("kind = 'blob'").withColumn("col", F.lit(-1))
    return page.unionByName(blobs).drop("failure")


@query("SELECT DISTINCT n_regionkey || '.db' AS path, 4096 AS page_size, 'UTF-8' AS encoding, false AS wal, n_regionkey - 2 AS user_version, n_regionkey + 7 AS application_id, true AS sized FROM nation")
def sqlite_header(spark, d):
    files = _databases(spark, d)
    facts = files.select("path", F.octet_length("content").alias("size"), databases.facts_of_header(F.col("content")).alias("f"))
    return facts.select("path", "f.page_size", "f.encoding", "f.wal", "f.user_version", "f.application_id", (F.col("f.page_size") * F.col("f.pages") == F.col("size")).alias("sized"))


def _delimited(spark, d, sep: str):
    """A text file for each region; names with the separator stand in quotes."""
    n = table(spark, d, "nation")
    line = F.concat_ws(sep, F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), F.col("n_name"), F.lit(f'{sep} ""x"""')))
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\r\n")
    return rows.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.concat(F.lit(f"key{sep}name\r\n"), body, F.lit("\r\n")), "UTF-8").alias("content"))


def _cells_sql(sep: str) -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)
SELECT n_regionkey || '.txt' AS path, k::INT AS row, 0 AS col, 'key' AS name, n_nationkey::VARCHAR AS value FROM r UNION ALL SELECT n_regionkey || '.txt', k::INT, 1, 'name', n_name || '{sep} "x"' FROM r"""


@query(_cells_sql(";"))
def csv_cells(spark, d):
    """Cells of files whose delimiter is sniffed."""
    return binary.rows_of(_delimited(spark, d, ";"), delimited.reader(), delimited.CELLS).drop("failure", "cut")


@query(_cells_sql("\t"))
def tsv_cells(spark, d):
    return binary.rows_of(_delimited(spark, d, "\t"), delimited.reader("\t"), delimited.CELLS).drop("failure", "cut")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)
SELECT n_regionkey || '.json' AS path, k::INT AS row, 0 AS col, 'key' AS name, n_nationkey::VARCHAR AS value FROM r UNION ALL SELECT n_regionkey || '.json', k::INT, 1, 'name', n_name FROM r UNION ALL SELECT n_regionkey || '.json', k::INT, 2, 'more', '{"of":[' || n_regionkey || ']}' FROM r""")
def json_table(spark, d):
    """Cells of a top-level array of objects."""
    n = table(spark, d, "nation").select("n_regionkey", F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.array("n_regionkey").alias("of")).alias("more")).alias("o"))
    files = n.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("j"))
    files = files.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(".json")).alias("path"), F.encode("j", "UTF-8").alias("content"))
    return binary.rows_of(files, delimited.json_cells, delimited.CELLS).drop("failure", "cut")


@query("""SELECT r_regionkey || '.json' AS path, '{' || chr(10) || '  "key": ' || r_regionkey || ',' || chr(10) || '  "names": [' || chr(10) || '    "' || r_name || '"' || chr(10) || '  ]' || chr(10) || '}' AS pretty FROM region""")
def json_pretty(spark, d):
    r = table(spark, d, "region").select(F.concat(F.col("r_regionkey").cast("string"), F.lit(".json")).alias("path"), F.encode(F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.array("r_name").alias("names"))), "UTF-8").alias("content"))
    return binary.rows_of(r, delimited.json_pretty, "pretty string").drop("failure")


_LATIN, _CYRILLIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБЦДЕФГХИЙКЛМНОПЯРСТУВШЫЗЖ"


@query(f"SELECT n_nationkey, 'Отчёт ' || lower(translate(n_name, '{_LATIN}', '{_CYRILLIC}')) || '.txt' AS name, '<?xml encoding=\"windows-1251\"?><a>Отчёт' || n_nationkey || '</a>' AS declared, 'ё' || n_nationkey || '.mp3' AS track FROM nation")
def code_pages(spark, d):
    """Names from three code pages, markup that names its own, and playlists that do not."""
    n = table(spark, d, "nation")
    page = F.when(F.col("n_nationkey") % 3 == 0, "cp866").when(F.col("n_nationkey") % 3 == 1, "cp1251").otherwise("utf-8")
    name = F.concat(F.lit("Отчёт "), F.lower(F.translate("n_name", _LATIN, _CYRILLIC)), F.lit(".txt"))
    key = F.col("n_nationkey").cast("string")
    markup = F.concat(F.lit('<?xml encoding="windows-1251"?><a>Отчёт'), key, F.lit("</a>"))
    of_list = F.when(F.col("n_nationkey") % 2 == 0, "cp1251").otherwise("utf-8")
    return n.select(
        "n_nationkey", codepages.anew_read_names(codepages.encoded(name, page)).alias("name"), codepages.declared_texts(codepages.encoded(markup, F.lit("cp1251"))).alias("declared"),
        codepages.playlist_texts(codepages.encoded(F.concat(F.lit("ё"), key, F.lit(".mp3")), of_list)).alias("track"),
    )


@query("WITH f AS (SELECT n_nationkey, n_nationkey % 5 AS k FROM nation) SELECT 'f' || n_nationkey || CASE k WHEN 0 THEN '.db' WHEN 1 THEN '.CSV' WHEN 2 THEN '.csv' WHEN 3 THEN '.none' ELSE '.json' END AS path, CASE k WHEN 0 THEN 'database' WHEN 1 THEN 'delimited' WHEN 2 THEN 'database' WHEN 4 THEN 'json' END AS reader, CASE k WHEN 3 THEN 0 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 1 END AS rows FROM f")
def reader_choice(spark, d):
    """The reader of each file and the rows that it gives: a database named .csv is a database, an unknown file has none."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (x)")
    base, k = con.serialize(), F.col("n_nationkey") % 5
    suffix = F.when(k == 0, ".db").when(k == 1, ".CSV").when(k == 2, ".csv").when(k == 3, ".none").otherwise(".json")
    content = F.when(k.isin(0, 2), F.lit(base)).when(k == 1, F.lit(b"a,b\n1,2\n")).when(k == 4, F.lit(b'[{"a": 1}]')).otherwise(F.lit(b"plain"))
    files = table(spark, d, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), suffix).alias("path"), content.alias("content"))
    chosen = files.select("path", registry.reader_of(F.col("path"), F.col("content")).alias("reader"))
    rows = None
    for name in ("database", "delimited", "json"):
        one = registry.read(files, name).select("path")
        rows = one if rows is None else rows.unionByName(one)
    return chosen.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("rows")), "path", "left").select("path", "reader", F.coalesce("rows", F.lit(0)).alias("rows"))
