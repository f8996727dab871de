"""DuckDB equivalents of the operator queries that SQL can express."""

from __future__ import annotations

from rivulet.llm.quality import BOILERPLATE, LONG, NAVIGATION_LINE, TEASER

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = f"""
WITH lines AS (
  SELECT doc_id, text, u.pos, u.line, {_LOWER.format(f"trim(u.line, {_WS})")} AS key
  FROM (SELECT doc_id, text, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'pos': i, 'line': x}})) AS u FROM documents)
), frequent AS (
  SELECT key FROM (SELECT DISTINCT doc_id, text, key FROM lines WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key) GROUP BY doc_id, text
"""

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
fine AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM fine),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN comp USING (vec_id)
"""

OP6 = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
m AS (SELECT *, n >= 1000 AND rank() OVER w > 1 AS again, first_value(page_id) OVER w AS first FROM d WINDOW w AS (PARTITION BY digest ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST))
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM m
"""

_BOILERPLATE = "|".join(BOILERPLATE)
OP7 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         list_filter(string_split(text, chr(10)), lambda x: NOT (
           (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 8 > length(x)
           OR (length(x) - length(replace(x, '!', ''))) * 10 > length(x)
           OR (len(regexp_split_to_array(x, ' [|•»·>] ')) - 1 >= 3 AND length(x) - length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) < 12 * (len(regexp_split_to_array(x, ' [|•»·>] ')) - 1))
           OR (length(x) <= 80 AND regexp_matches(x, '(?i){NAVIGATION_LINE}'))
           OR (length(x) - length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) < 11 AND regexp_matches(x, '{TEASER}'))
           OR (length(x) <= {LONG} AND regexp_matches(x, '(?i){_BOILERPLATE}')))) AS good
  FROM t),
win AS (SELECT doc_id, text, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g FROM (SELECT doc_id, text, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM lines)),
rep AS (SELECT doc_id, text, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, text, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, text, count(DISTINCT j) AS n FROM (SELECT doc_id, text, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id, text),
s AS (
  SELECT doc_id, text, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         length(array_to_string(good, chr(10))) AS kept_chars, length(text) AS chars
  FROM lines)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AND (chars = 0 OR kept_chars / chars >= 0.5) AS kept
FROM s LEFT JOIN cov USING (doc_id, text)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3, "op4_embedding_dedup": OP4, "op6_warc": OP6, "op7_quality_rules": OP7}
