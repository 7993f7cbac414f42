"""Column functions applied to the driver's tables and to literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import formatcodes as fc, numbers as nm, text as tx
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table


def _size_sql(names: list[str], step: int, plain: str) -> str:
    def shown(u: int) -> str:
        q = f"((s * 10) // {u} + CASE WHEN 2 * ((s * 10) % {u}) > {u} OR (2 * ((s * 10) % {u}) = {u} AND (s * 10) // {u} % 2 = 1) THEN 1 ELSE 0 END)"
        return f"{q} // 10 || '.' || {q} % 10"

    arms = [f"WHEN s >= {step ** (k + 1)} THEN {shown(step ** (k + 1))} || '{n}'" for k, n in reversed(list(enumerate(names)))]
    return f"CASE {' '.join(arms)} ELSE s || '{plain}' END"


@query(f"""SELECT doc_id, {_size_sql([' KB', ' MB', ' GB', ' TB'], 1024, ' B')} AS long_form, {_size_sql(['K', 'M', 'G', 'T'], 1024, '')} AS short_form, {_size_sql([' kB', ' MB', ' GB', ' TB', ' PB'], 1000, ' bytes')} AS decimal_form
FROM (SELECT doc_id, n_chars * power(17, doc_id % 9)::BIGINT AS s FROM documents)""")
def human_size(spark, d):
    s = F.col("s")
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * F.pow(F.lit(17), F.col("doc_id") % 9).cast("long")).alias("s"))
    return rows.select("doc_id", nm.human_size(s).alias("long_form"), nm.human_size_short(s).alias("short_form"), nm.human_size_decimal(s).alias("decimal_form"))


@query("SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(trunc(v))::BIGINT), ',', chr(8239)) || '.' || lpad(((abs(v) * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS shown FROM (SELECT o_orderkey, round((o_totalprice - 200000)::DECIMAL(30, 10), 2) AS v FROM orders)")
def number_format_grouped(spark, d):
    return table(spark, d, "orders").select("o_orderkey", nm.grouped(F.col("o_totalprice") - 200000).alias("shown"))


@query("""WITH v AS (SELECT o_orderkey, (o_totalprice - 200000) / 1000 AS v FROM orders), r AS (SELECT o_orderkey, v, round(abs(v)::VARCHAR::DECIMAL(38, 15), 1) AS one, round(abs(v * 100)::VARCHAR::DECIMAL(38, 15), 0)::BIGINT AS hundredths, round(abs(v)::VARCHAR::DECIMAL(38, 15), 2) AS two, round(abs(v) * 16)::BIGINT AS parts FROM v)
SELECT o_orderkey, CASE WHEN v < 0 AND one > 0 THEN '-' ELSE '' END || one::DECIMAL(30, 1)::VARCHAR AS tenths, CASE WHEN v < 0 AND hundredths > 0 THEN '-' ELSE '' END || hundredths || '%' AS percent,
CASE WHEN v < 0 THEN '(' || replace(two::DECIMAL(30, 2)::VARCHAR, '.', ',') || ')' ELSE replace(two::DECIMAL(30, 2)::VARCHAR, '.', ',') || ' ₽' END AS money, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN parts = 0 THEN '0' ELSE parts || '/16' END AS sixteenths FROM r""")
def number_formats(spark, d):
    """Format codes of one and of several sections."""
    v = F.col("v")
    rows = table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 200000) / 1000).alias("v"))
    return rows.select("o_orderkey", fc.formatted(v, "0.0").alias("tenths"), fc.formatted(v, "0%").alias("percent"), fc.formatted(v, '0.00 "₽";(0.00)', "ru").alias("money"), fc.formatted(v, "?/16").alias("sixteenths"))


@query("SELECT o_orderkey, CASE WHEN s < 60 THEN TIMESTAMP '1899-12-31' ELSE TIMESTAMP '1899-12-30' END + to_days(floor(s)::INT) + to_milliseconds(round((s - floor(s)) * 86400000)::BIGINT) AS at FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 64)::DOUBLE ELSE o_orderkey % 40000 + 0.25 END AS s FROM orders)")
def serial_dates(spark, d):
    s = F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 64).cast("double")).otherwise(F.col("o_orderkey") % 40000 + F.lit(0.25))
    return table(spark, d, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", nm.from_serial(F.col("s")).alias("at"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_partkey AS r, '' AS s FROM part UNION ALL SELECT p_partkey, (r - 1) // 26, chr((65 + (r - 1) % 26)::INT) || s FROM p WHERE r > 0)
SELECT p_partkey, s AS letters, p_partkey - 1 AS back FROM p WHERE r = 0""")
def cell_references(spark, d):
    rows = table(spark, d, "part").select("p_partkey", nm.column_letters(F.col("p_partkey")).alias("letters"))
    return rows.withColumn("back", nm.column_index(F.concat("letters", F.lit("12"))))


@query("SELECT p_partkey, " + " || ".join(f"CASE WHEN p_partkey % 512 & {1 << (8 - k)} <> 0 THEN '{'rwx'[k % 3]}' ELSE '-' END" for k in range(9)) + " AS mode FROM part")
def mode_bits(spark, d):
    return table(spark, d, "part").select("p_partkey", nm.mode_bits((F.col("p_partkey") % 512).cast("int")).alias("mode"))


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN round_even(packed::DECIMAL(30, 6) * 100 / n_chars, 0)::BIGINT || '%' ELSE '' END AS ratio FROM (SELECT doc_id, n_chars, (n_chars * (doc_id % 10)) // 10 AS packed FROM documents)")
def ratio_pct(spark, d):
    packed = F.floor(F.col("n_chars") * (F.col("doc_id") % 10) / 10)
    return table(spark, d, "documents").select("doc_id", nm.ratio_percent(packed, F.col("n_chars")).alias("ratio"))


@query("""SELECT event_id, CASE WHEN s > 0 THEN (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE '' END AS minutes,
CASE WHEN s <= 0 THEN '' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS hours,
CASE WHEN s < 90 THEN 'just now' WHEN s < 5400 THEN (s // 60) || ' minutes ago' ELSE (s // 3600) || ' hours ago' END AS age
FROM (SELECT event_id, (event_id * 37 % 20000)::BIGINT AS s FROM events)""")
def clock(spark, d):
    s = F.col("event_id") * 37 % 20000
    return table(spark, d, "events").select("event_id", nm.clock_minutes(s).alias("minutes"), nm.clock_hours(s).alias("hours"), nm.ago(s).alias("age"))


@query("""SELECT p_partkey, round((p_partkey % 180 + (p_partkey % 60) / 60.0::DOUBLE + (p_partkey % 37) / 3600.0::DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END, 6) AS degrees,
round(p_size * 100.0::DOUBLE * p_partkey / 1e6, 1) AS megapixels, round(0.299 * p_size::DOUBLE + 0.587 * (p_size + 1) + 0.114 * (p_size + 2), 6) AS luma FROM part""")
def photo_numbers(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", nm.degrees(k % 180, k % 60, k % 37, F.when(k % 2 == 0, "S").otherwise("N")).alias("degrees"), nm.megapixels(size * 100, k).alias("megapixels"), F.round(nm.luma(size, size + 1, size + 2), 6).alias("luma")
    )


@query("SELECT p_partkey, CASE WHEN s < 1 THEN '1/' || round_even(1 / s, 0)::BIGINT || ' s' ELSE regexp_replace(printf('%.1f', s), '\\.0$', '') || ' s' END AS shutter FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS s FROM part)")
def shutter(spark, d):
    return table(spark, d, "part").select("p_partkey", nm.shutter(F.col("p_size") / 10.0).alias("shutter"))


@query("""SELECT a, b, a * b // 255 AS multiply, 255 - (255 - a) * (255 - b) // 255 AS screen, CASE WHEN a < 128 THEN 2 * a * b // 255 ELSE 255 - 2 * (255 - a) * (255 - b) // 255 END AS overlay, abs(a - b) AS difference
FROM (SELECT p_partkey % 256 AS a, (p_partkey * 7) % 256 AS b FROM part)""")
def blend_modes(spark, d):
    a, b = F.col("a"), F.col("b")
    rows = table(spark, d, "part").select((F.col("p_partkey") % 256).alias("a"), (F.col("p_partkey") * 7 % 256).alias("b"))
    return rows.select("a", "b", *[nm.blend(a, b, m).alias(m) for m in ("multiply", "screen", "overlay", "difference")])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN v & 1 <> 0 THEN (v >> 2)::DOUBLE / 100 ELSE (v >> 2)::DOUBLE END AS value FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 4 + 2 + l_linenumber % 2)::BIGINT AS v FROM lineitem)")
def packed_numbers(spark, d):
    v = F.col("l_partkey") * 4 + 2 + F.col("l_linenumber") % 2
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nm.rk(v.cast("long")).alias("value"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(substr(text, 1, 200), chr(10)) AND regexp_extract(substr(text, 1, 200), '(?s)^(.*)\\n', 1) <> '' THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*)\\n', 1) ELSE substr(text, 1, 200) END AS cut,
CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '…' ELSE text END AS capped, lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS norm,
regexp_replace(text, '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g') AS escaped, '"' || replace(source, '"', '""') || '"' AS quoted, trim(string_split(text, chr(10))[1]) AS first_line FROM documents""")
def text_forms(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", tx.cut_at_line(t, 200).alias("cut"), tx.capped(t, 50).alias("capped"), tx.title_norm(t).alias("norm"), tx.md_escape(t).alias("escaped"),
        tx.quoted(F.col("source")).alias("quoted"), tx.first_line(t).alias("first_line"),
    )


@query("SELECT item_id, '--- /dev/null' || chr(10) || '+++ b/item/' || item_id || chr(10) || '@@ -0,0 +1,' || len(ls) || ' @@' || chr(10) || array_to_string(list_transform(ls, lambda x: '+' || x), chr(10)) AS diff FROM (SELECT item_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM benchmark)")
def addition_diff(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.addition_diff(F.concat(F.lit("item/"), F.col("item_id").cast("string")), F.col("text")).alias("diff"))


@query("SELECT * FROM (VALUES ('png', 'PNG'), ('jpg', 'JPEG'), ('gif', 'GIF'), ('pdf', 'PDF'), ('zip', 'ZIP'), ('webp', 'WebP'), ('gz', 'gzip'), ('txt', 'binary')) v(name, kind)")
def blob_kind(spark, d):
    heads = [("png", "89504E470D0A1A0A00"), ("jpg", "FFD8FFE0"), ("gif", "474946383961"), ("pdf", "255044462D31"), ("zip", "504B030414"), ("webp", "524946460000000057454250"), ("gz", "1F8B08"), ("txt", "68656C6C6F")]
    return spark.createDataFrame(heads, "name string, head string").select("name", tx.blob_kind(F.unhex("head")).alias("kind"))


@query("SELECT * FROM (VALUES (1, 'I', 'A'), (4, 'IV', 'D'), (1994, 'MCMXCIV', 'BXR'), (3999, 'MMMCMXCIX', 'EWU'), (4000, '4000', 'EWV'), (27, 'XXVII', 'AA')) v(n, roman, letters)")
def list_numerals(spark, d):
    n = F.col("n")
    return spark.createDataFrame([(k,) for k in (1, 4, 1994, 3999, 4000, 27)], "n int").select("n", nm.roman(n).alias("roman"), nm.column_letters(n).alias("letters"))


@query("SELECT * FROM (VALUES ('HEAD -> main, tag: v1, origin/x, topic', 'head:main,tag:v1,remote:origin/x,branch:topic'), ('', '')) v(said, refs)")
def decorations(spark, d):
    rows = spark.createDataFrame([("HEAD -> main, tag: v1, origin/x, topic",), ("",)], "said string")
    return rows.select("said", F.array_join(F.transform(tx.decorations(F.col("said")), lambda r: F.concat_ws(":", r["kind"], r["name"])), ",").alias("refs"))


@query("SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\\s*[-*•–]\\s') THEN 'bullet' WHEN regexp_matches(line, '^\\s*[0-9]{1,3}[.)]\\s') THEN 'number' WHEN regexp_matches(line, '^\\s*[a-z][.)]\\s') THEN 'letter' ELSE '' END AS marker FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM documents)")
def list_markers(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), tx.list_marker(F.col("line")).alias("marker"))
