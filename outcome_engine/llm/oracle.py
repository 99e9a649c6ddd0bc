"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URLS_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*', '', 's') END AS rest FROM pages),
parts AS (
  SELECT page_id,
    coalesce(translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END, '') AS path FROM rest),
judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    CASE WHEN host || path LIKE '%casino%' THEN '*casino*' WHEN host || path LIKE '%gambl%' THEN '*gambl*'
         WHEN host || path LIKE '%-bets.%' THEN '*-bets.*' WHEN host || path LIKE '%spam%' THEN '*spam*'
         WHEN host || path LIKE '%ads-%' THEN '*ads-*' WHEN host || path LIKE '%tracker%' THEN '*tracker*'
         WHEN host || path LIKE '%porn%' THEN '*porn*' WHEN host || path LIKE '%/wp-login%' THEN '*/wp-login*'
         WHEN host || path LIKE '%.exe' THEN '*.exe' END AS method_rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN host = '' OR method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, method_rule
FROM judged
"""

LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
keyed AS (
  SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.doc_id, n, line, f.key IS NOT NULL AND k.doc_id > f.first AS gone FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


# All phrases of up to five words counted one by one, every longer candidate searched for every shorter one.
PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
sized AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM cut),
grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, phrase, k AS m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
parted AS (SELECT *, unnest(range(1, m)) AS j FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.m, c.a, c.j, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parted c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:c.m], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = c.lang AND q.m > c.m AND 100 * q.a >= 100 * c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000
"""

# Every 400 bytes of every text as hexadecimal digits, by digest; repeated ones joined to spans.
PASSAGES_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, hex(coalesce(text, '')) AS h FROM documents),
places AS (SELECT row, h, unnest(range(0, len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800),
windows AS (SELECT row, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM places),
starts AS (SELECT row, p FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT row, p, (p - lag(p) OVER (PARTITION BY row ORDER BY p) <= 400) IS NOT TRUE AS opens FROM starts),
numbered AS (SELECT row, p, sum(opens::INT) OVER (PARTITION BY row ORDER BY p) AS span FROM marked),
spans AS (SELECT row, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY row, span),
gaps AS (SELECT row, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS x, a AS y FROM spans UNION ALL SELECT row, max(b), NULL FROM spans GROUP BY row),
kept AS (SELECT g.row, string_agg(substr(d.h, 2 * x + 1, 2 * (coalesce(y, len(d.h) // 2) - x)), '' ORDER BY x) AS h FROM gaps g JOIN d ON d.row = g.row GROUP BY g.row),
sizes AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY row)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.row = d.row LEFT JOIN sizes ON sizes.row = d.row
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_lines": LINES_SQL, "op9_urls": URLS_SQL, "op12_phrases": PHRASES_SQL, "op13_passages": PASSAGES_SQL}
