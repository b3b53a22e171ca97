"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

NGRAM_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * o >= 85 * (sx.n + sy.n - o)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(y), w.doc_id)) AS component_id,
  1 + count(DISTINCT CASE WHEN same THEN y END) AS n_copies
FROM w LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT r.x, r.y, coalesce(o = sx.n AND o = sy.n, false) AS same FROM reach r JOIN sizes sx ON sx.doc_id = r.x JOIN sizes sy ON sy.doc_id = r.y LEFT JOIN shared s ON s.x = r.x AND s.y = r.y WHERE r.x <> r.y) r ON r.x = w.doc_id
GROUP BY w.doc_id
"""

RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM starts),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE k > 1) GROUP BY 1),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS upper_letters, length(regexp_replace(t, '[^!]+', '', 'g')) AS marks, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN repeats USING (doc_id)),
c AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * upper_letters > word_chars OR 2 * marks > n_words OR 2 * n_dup_lines > len(lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM c
"""
