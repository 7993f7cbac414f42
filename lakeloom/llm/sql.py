"""DuckDB twins of the training-data queries, written from the contracts."""

from __future__ import annotations

from lakeloom.llm import quality as q

W = r"[^\x20\x09-\x0D]"


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: The rule table as the twin has it: name, measure and bounds, stated again so that a wrong threshold of the operator shows.
QUALITY = (
    ("too_few_words", "n_words", 50, None), ("too_many_words", "n_words", None, 1000000), ("short_words", "mean_word_length", 2, None), ("long_words", "mean_word_length", None, 14),
    ("symbols", "symbols_per_word", None, 0.1), ("repeated_lines", "dup_line_ratio", None, 0.3), ("repeated_words", "repeat_word_ratio", None, 0.5), ("no_stop_words", "stop_words", 2, None),
    ("few_stop_words", "stop_word_ratio", 0.01, None), ("few_letters", "letter_word_ratio", 0.6, None), ("bullets", "bullet_line_ratio", None, 0.9), ("ellipses", "ellipsis_line_ratio", None, 0.3),
)


def quality() -> str:
    forms = sorted({form for w in q.STOP_WORDS for form in (w, w.capitalize())})
    measure = {
        "n_words": "n_words::DOUBLE",
        "stop_words": "n_stop::DOUBLE",
        "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop_uses::DOUBLE / n_words ELSE 0 END",
        "mean_word_length": "CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END",
        "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END",
        "repeat_word_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END",
        "letter_word_ratio": "CASE WHEN n_words > 0 THEN n_letter::DOUBLE / n_words ELSE 0 END",
        "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END",
        "bullet_line_ratio": "CASE WHEN n_lines > 0 THEN n_bullet::DOUBLE / n_lines ELSE 0 END",
        "ellipsis_line_ratio": "CASE WHEN n_lines > 0 THEN n_ellipsis::DOUBLE / n_lines ELSE 0 END",
    }
    broken = []
    for name, of, least, most in QUALITY:
        tests = [f"({measure[of]}) < {least}"] * (least is not None) + [f"({measure[of]}) > {most}"] * (most is not None)
        broken.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{W}+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) AS ls
  FROM d
),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
),
found AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, three) AS n FROM win),
rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM found WHERE n > 1) GROUP BY rid
),
c AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - list_unique(ls))::BIGINT AS n_dup_lines,
         coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         len(list_distinct(list_filter(ws, lambda x: list_contains([{_listed(forms)}], x)))) AS n_stop,
         len(list_filter(ws, lambda x: list_contains([{_listed(forms)}], x))) AS n_stop_uses,
         len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\t]*[-*•]'))) AS n_bullet,
         len(list_filter(ls, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…)[\\x20\\t\\r]*$'))) AS n_ellipsis
  FROM w LEFT JOIN rep USING (rid)
),
v AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         concat_ws(',', {", ".join(broken)}) AS broken_rules
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND broken_rules = '') AS kept, broken_rules
FROM v
"""


def mixing() -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey, len(regexp_extract_all(coalesce(text, ''), '{W}+'))::BIGINT AS size
  FROM documents
),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (
  SELECT skey, source_size, source_size * 3.0::DOUBLE AS cap,
         (((row_number() OVER (ORDER BY skey)) - 1) % 3 + 1)::DOUBLE AS weight, (sum(source_size) OVER ())::DOUBLE AS total
  FROM s
),
-- A level of water: each source takes least(cap, level * weight); the level is that of the first source, in order of cap over weight, that stays below its cap.
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM w WINDOW o AS (ORDER BY cap / weight, skey)
),
t AS (SELECT skey, source_size, CASE WHEN cap <= own_level * weight THEN cap ELSE max(CASE WHEN cap > own_level * weight THEN own_level END) OVER () * weight END AS target FROM l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY skey ORDER BY size, coalesce(doc_id % 4096, 0), doc_id) AS k FROM d),
x AS (
  SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
         ('0x' || substr(md5('17:' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM r JOIN t USING (skey)
)
SELECT doc_id, size, source_size, target, (size * (floor(ratio * k + shift) - floor(ratio * (k - 1) + shift))::BIGINT)::BIGINT AS taken
FROM x
"""


def secrets() -> str:
    base = {
        "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "mixed": "[A-Za-z0-9+/_-]+",
    }
    value = {"assign": f"regexp_extract(hit, '{base['assign'].replace(chr(39), chr(39) * 2)}', 2)"}
    test = {"assign": "length(v) >= 6", "access": "length(v) >= 20", "hex": "length(v) >= 24", "mixed": "length(v) >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"}
    parts = []
    for rank, (kind, pattern) in enumerate(base.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT rid, src, doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(hit) AS stop, v FROM (
    SELECT *, {value.get(kind, 'hit')} AS v,
           (sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid ORDER BY i) - coalesce(length(hit), 0))::BIGINT AS s
    FROM (SELECT rid, src, doc_id, i, gap, hit FROM (
      SELECT rid, src, doc_id, unnest(gaps) AS gap, unnest(list_append(hits, NULL)) AS hit, generate_subscripts(gaps, 1) AS i FROM (SELECT rid, src, doc_id, regexp_split_to_array(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM d)))
  ) WHERE hit IS NOT NULL AND {test[kind]}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS src, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(DISTINCT src) AS owners, count(DISTINCT doc_id) AS repositories FROM c GROUP BY v),
k AS (SELECT c.*, repositories, owners >= 3 OR owners >= 2 AND repositories >= 10 AS copied FROM c JOIN o USING (v)),
j AS (SELECT *, NOT copied AND len(list_distinct(string_split(v, ''))) >= 8 AS live FROM k),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'mixed'), '') AS base,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> 'mixed' OR live), '') AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (copied AND kind <> 'mixed') AS n_copied, max(repositories) FILTER (kind <> 'mixed' OR live) AS most_repositories
  FROM j GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN g USING (rid)
"""
