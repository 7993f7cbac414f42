"""Links, tables and text of web pages, and Python-backed readers of formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import text as tx
from lakeloom.operators import generations, pytext, webpages
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table

_LINKS = r"""h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), 1) AS seq FROM pages),
a AS (SELECT page_id, seq, url, regexp_replace(CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END, '#.*$', '') AS target FROM h WHERE NOT regexp_matches(href, '^(mailto|javascript|data|tel|about|blob):')),
l AS (SELECT page_id, target, min(seq) AS seq, any_value(url) AS url FROM a WHERE regexp_matches(target, '^https?://') AND target <> regexp_replace(url, '#.*$', '') GROUP BY page_id, target)"""


@query(f"WITH {_LINKS} SELECT page_id, (seq - 1)::INT AS seq, target, regexp_extract(target, '^[a-z]+://([^/?#]+)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS same_host FROM l")
def page_links(spark, d):
    return webpages.anchors(table(spark, d, "pages")).select("page_id", "seq", "target", "same_host")


@query(f"WITH {_LINKS}, s AS (SELECT page_id, target, lower(regexp_extract(regexp_extract(target, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.([A-Za-z0-9]+)$', 1)) AS suffix FROM l) SELECT page_id, target, suffix, suffix IN ('', 'html', 'htm', 'xhtml', 'php', 'asp', 'aspx', 'jsp', 'cgi') AS is_page FROM s")
def page_or_file(spark, d):
    rows = webpages.anchors(table(spark, d, "pages"))
    return rows.select("page_id", "target", tx.suffix(F.col("target")).alias("suffix"), tx.is_page(F.col("target"), F.lit("a")).alias("is_page"))


@query(f"WITH {_LINKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq)::INT - 1 AS seq, 'a' AS tag, target, regexp_extract(target, '^[a-z]+://([^/?#]+)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS same_host FROM l")
def all_links(spark, d):
    """Links of all tags that carry URLs; the driver's pages have anchors alone."""
    return webpages.links(table(spark, d, "pages"))


@query(f"WITH {_LINKS}, k AS (SELECT *, regexp_extract(target, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS own, regexp_extract(regexp_replace(regexp_extract(target, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS last, regexp_extract(target, '\\?(.*)$', 1) AS q FROM l), n AS (SELECT page_id, seq, replace(CASE WHEN host = own THEN '' ELSE host || ' · ' END || CASE WHEN last = '' THEN host WHEN q <> '' THEN last || '?' || q[1:40] ELSE last END, '/', '_') AS name, host = own AND lower(regexp_extract(last, '\\.([A-Za-z0-9]+)$', 1)) IN ('', 'html', 'htm', 'xhtml', 'php', 'asp', 'aspx', 'jsp', 'cgi') AS is_page FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY seq) AS nth, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS r FROM n) SELECT page_id, r::INT - 1 AS seq, CASE WHEN nth = 1 THEN name ELSE name || ' (' || nth || ')' END AS name, is_page FROM o")
def resource_names(spark, d):
    """A page's links as a listing of pages and files."""
    return webpages.resources(webpages.links(table(spark, d, "pages")))


_BLOCKS = r"""regexp_replace(regexp_replace(replace(replace(regexp_replace(html, '(?s)<head>.*?</head>|<!--.*?-->', '', 'g'), '<li>', chr(1) || '- '), '<h1>', chr(1) || '# '), '</?(p|div|article|section|tr|br|body|nav|footer|ul|li|h1)( [^>]*)?>', chr(1), 'g'), '<[^>]+>', '', 'g')"""


@query(f"""WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(replace({_BLOCKS}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(x, chr(1)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10) || chr(10)) AS markdown FROM t""")
def html_markdown(spark, d):
    """Pages as Markdown; the twin knows the tags of the driver's pages alone."""
    return webpages.markdown(table(spark, d, "pages"))


_CELLS = "c AS (SELECT r_regionkey AS page_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i, n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey)"


@query(f"WITH {_CELLS}, a AS (SELECT DISTINCT page_id FROM c) SELECT page_id, 0 AS table_no, 0 AS row_no, 0 AS col_no, 'key & name' AS value, true AS strong FROM a UNION ALL SELECT page_id, 0, 0, 2, 'note', true FROM a UNION ALL SELECT page_id, 0, i::INT, 0, n_nationkey::VARCHAR, false FROM c UNION ALL SELECT page_id, 0, i::INT, 1, n_name, false FROM c UNION ALL SELECT page_id, 1, 0, 0, 'inner', false FROM a")
def html_tables(spark, d):
    """Cells of the tables of the pages, of which the driver's have none, and of a page for each region that lists its nations."""
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    cells = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<tr><td>"), r["n_nationkey"].cast("string"), F.lit("</td><td><b>"), r["n_name"], F.lit("</b></td></tr>\n"))), "")
    head, foot = "<p>x</p><table><tr><th colspan=2>key &amp;  name</th><th>note</th></tr>", "</table><table><tr><td>in<i>n</i>er</td></tr></table>"
    made = nations.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("page_id"), F.concat(F.lit(head), cells, F.lit(foot)).alias("html"))
    return webpages.tables(made.unionByName(table(spark, d, "pages").select("page_id", "html")))


@query("WITH l AS (SELECT item_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM benchmark) SELECT item_id, '--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1' || CASE WHEN len(lines) > 1 THEN ',' || len(lines) ELSE '' END || ' +1' || CASE WHEN len(lines) > 1 THEN ',' || len(lines) ELSE '' END || ' @@' || chr(10) || array_to_string(list_concat(list_transform(lines, lambda x: '-' || x), list_transform(lines, lambda x: '+X' || x)), chr(10)) AS diff FROM l")
def unified_diff(spark, d):
    """A diff in which every line changes."""
    b = table(spark, d, "benchmark").select("item_id", "text", F.concat(F.lit("X"), F.regexp_replace("text", "\n(?!$)", "\nX")).alias("other"))
    return b.select("item_id", pytext.unified_diff("text", "other").alias("diff"))


@query("SELECT item_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM benchmark")
def decode_repair(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-16LE").alias("data"))
    return b.select("item_id", pytext.decoded("data").alias("text"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, list_reduce(lines, lambda out, x: CASE WHEN len(out) > 0 AND length(out[-1]) >= 30 AND right(out[-1], 1) NOT IN ('.', '!', '?', ':', ';', '"', chr(39)) THEN list_concat(out[:-2], [CASE WHEN right(out[-1], 1) = '-' THEN left(out[-1], -1) || x ELSE out[-1] || ' ' || x END]) ELSE list_append(out, x) END, []::VARCHAR[]) AS paragraphs FROM l""")
def paragraph_join(spark, d):
    return table(spark, d, "documents").select("doc_id", pytext.joined_paragraphs("text").alias("paragraphs"))


@query("""SELECT doc_id AS id, unnest(['Prompt', 'Negative', 'Steps', 'Sampler', 'Seed', 'Model', 'LoRA fur', 'LoRA tail']) AS label, unnest([left(source, 40) || ', <lora:fur:0.7>', 'dog, blurry' || chr(10) || 'rain', (doc_id % 50)::VARCHAR, 'Euler a', doc_id::VARCHAR, 'base, "v2"', '0.7', '?']) AS value FROM documents""")
def recipe_fields(spark, d):
    """Fields of a block that names each document."""
    block = F.concat(
        F.substring("source", 1, 40), F.lit(", <lora:fur:0.7>\nNegative prompt: dog, blurry\nrain\nSteps: "), (F.col("doc_id") % 50).cast("string"), F.lit(", Sampler: Euler a, Seed: 1, Seed: "),
        F.col("doc_id").cast("string"), F.lit(', Model: "base, \\"v2\\"", Lora hashes: "fur: ab12, tail: cd34"'),
    )
    return pytext.recipes(table(spark, d, "documents").select("doc_id", block.alias("text")), "doc_id", "text")


@query("SELECT * FROM (VALUES (1, 'Song', 194, '/m/a.mp3', false), (2, '', 0, 'http://x/y.mp3', true), (3, 'Last', 5, '/abs/c.mp3', false)) v(ord, title, seconds, target, remote)")
def playlist_tracks(spark, d):
    text = "#EXTM3U\n#EXTINF:194,Song\n#comment\na.mp3\nhttp://x/y.mp3\n#EXTINF:9,Dropped\n#EXTINF:5,Last\n/abs/c.mp3\n"
    return webpages.playlist(spark.createDataFrame([(text,)], "text string"), "/m")


_SAID = "CASE event_id % 6 WHEN 0 THEN 'InvokeAI' WHEN 1 THEN 'NovelAI' WHEN 2 THEN 'Unknown tool' WHEN 3 THEN 'AUTOMATIC1111' WHEN 4 THEN 'ComfyUI' ELSE 'Midjourney' END"


@query(f"""WITH e AS (SELECT event_id AS id, event_type, user_id, event_id % 6 AS k, {_SAID} AS tool FROM events), f AS (
SELECT id, tool, 'Prompt' AS label, 'a ' || event_type AS value FROM e UNION ALL
SELECT id, tool, CASE k WHEN 5 THEN 'Aspect ratio' ELSE 'Seed' END, CASE k WHEN 5 THEN '16:9' ELSE user_id::VARCHAR END FROM e UNION ALL
SELECT id, tool, 'Negative', 'rain' FROM e WHERE k IN (1, 3, 5) UNION ALL SELECT id, tool, 'Size', '512×768' FROM e WHERE k IN (0, 2) UNION ALL SELECT id, tool, 'Steps', '20' FROM e WHERE k = 3 UNION ALL SELECT id, tool, 'Model', 'm' FROM e WHERE k = 0 UNION ALL
SELECT id, tool, unnest(['CFG', 'LoRA l', 'Checkpoint', 'Passes', 'Nodes']), unnest(['7.5', '0.8', 'c', '12', '7']) FROM e WHERE k = 4) SELECT * FROM f""")
def picture_recipes(spark, d):
    """Pictures of six tools, each recognised by what it carries; the graph's sampler takes its seed from a node and its prompt over another."""
    k = F.col("event_id") % 6
    prompt, seed = F.concat(F.lit("a "), F.col("event_type")), F.col("user_id").cast("string")
    graph = F.concat(
        F.lit('{"9": {"class_type": "KSampler", "inputs": {"positive": ["3", 0], "seed": ["4", 0], "cfg": 7.5, "model": ["5", 0]}}, "12": {"class_type": "KSampler", "inputs": {"latent_image": ["9", 0]}}, "3": {"class_type": "Combine", "inputs": {"conditioning": ["2", 0]}}, "2": {"class_type": "CLIPTextEncode", "inputs": {"text": "'),
        prompt, F.lit('"}}, "4": {"class_type": "Primitive", "inputs": {"value": '), seed, F.lit('}}, "5": {"class_type": "LoraLoader", "inputs": {"lora_name": "l", "strength_model": 0.8, "model": ["6", 0]}}, "6": {"class_type": "Loader", "inputs": {"ckpt_name": "c"}}}'),
    )
    one = lambda name, *parts: F.create_map(F.lit(name), F.concat(*parts))
    carried = (
        F.when(k == 0, one("invokeai_metadata", F.lit('{"positive_prompt": "'), prompt, F.lit('", "seed": '), seed, F.lit(', "width": 512, "height": 768, "model": {"name": "m"}}')))
        .when(k == 1, one("Comment", F.lit('{"prompt": "'), prompt, F.lit('", "uc": "rain", "seed": '), seed, F.lit("}")))
        .when(k == 2, one("parameters", F.lit('{"Prompt": "'), prompt, F.lit('", "noise_seed": '), seed, F.lit(', "Resolution": "512×768"}')))
        .when(k == 3, one("parameters", prompt, F.lit("\nNegative prompt: rain\nSteps: 20, Seed: "), seed))
        .when(k == 4, one("prompt", graph))
        .otherwise(one("Description", prompt, F.lit(" --ar 16:9 --no rain Job ID: 1-2")))
    )
    return generations.recognised(table(spark, d, "events").select("event_id", carried.alias("carried")), "event_id", "carried")
