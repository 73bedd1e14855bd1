"""DuckDB statements with the same rows as the queries of this subpackage.

Only line de-duplication and the quality rules can be said in SQL: the others need tokenizers,
seeded 64-bit hashes, fitted models or keyed digests, and are tested against plain versions.
"""

from __future__ import annotations

from . import op3_lines, op6_rules

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), {LOWER}) AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {op3_lines.MIN_DOCS}),
marked AS (SELECT k.*, h.key IS NOT NULL AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
flat AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
three AS (
  SELECT doc_id, pos, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
),
again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM three WHERE third IS NOT NULL),
repeated AS (
  SELECT doc_id, count(DISTINCT pos + step) AS n FROM again, (SELECT unnest([0, 1, 2]) AS step) WHERE n >= 2 GROUP BY doc_id
),
lines AS (SELECT doc_id, host, md5(text) AS t, unnest(string_split(text, chr(10))) AS raw FROM d),
dup AS (SELECT doc_id, count(raw) - count(DISTINCT raw) AS n FROM lines WHERE trim(raw, {BLANKS}) <> '' GROUP BY doc_id),
norm AS (SELECT doc_id, host, t, trim(translate(lower(raw), '123456789', '000000000'), {BLANKS}) AS line FROM lines),
frequent AS (SELECT host, line FROM norm WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT t) >= {op6_rules.LINE_DOCS}),
removed AS (SELECT doc_id, count(*) AS lines_removed, sum(length(line) + 1)::BIGINT AS chars_removed FROM norm JOIN frequent USING (host, line) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(w.words)::BIGINT AS n_words, length(translate(d.text, {BLANKS}, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lines_removed, 0)::BIGINT AS lines_removed, coalesce(chars_removed, 0)::BIGINT AS chars_removed, length(d.text) AS n_chars
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)
),
judged AS (SELECT *, n_words < {op6_rules.MIN_WORDS} OR 100 * n_repeat_words > {op6_rules.MAX_REPEATED} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines_removed, chars_removed, base_failed,
       NOT base_failed AND NOT n_chars - chars_removed < {op6_rules.LEFT}::DOUBLE * n_chars AS kept
FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP, "op6_quality_rules": QUALITY_RULES}
