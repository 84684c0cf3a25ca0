"""DuckDB SQL that states the results of operators from the test tables alone."""

from __future__ import annotations

from islet.llm.licenses import TEMPLATES

_MARKS = "^((?:[ \\t]*>)+)"
_VERBS = "(?i)\\b(?:wrote|writes|said|schrieb|écrit|escribió|ha scritto)\\b[^:]*:\\s*$"

#: Lines, runs of lines, runs of five words, and the first turn that says them.
QUOTATIONS = rf"""
WITH m AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
raw AS (SELECT id, conv_id, turn, unnest(a) AS raw, generate_subscripts(a, 1) AS line FROM (SELECT id, conv_id, turn, regexp_split_to_array(t, '\r\n|\n|\r') AS a FROM m)),
q AS (SELECT id, conv_id, turn, line, raw, length(regexp_replace(regexp_extract(raw, '{_MARKS}'), '[ \t]', '', 'g')) AS level, regexp_replace(raw, '{_MARKS}', '') AS said FROM raw),
ahead AS (SELECT *, lead(level) OVER w AS l1, lead(said) OVER w AS s1, lead(level, 2) OVER w AS l2, lead(said, 2) OVER w AS s2 FROM q WINDOW w AS (PARTITION BY id ORDER BY line)),
l AS (SELECT id, conv_id, turn, line, raw, level, said FROM ahead WHERE NOT coalesce(regexp_matches(said, '{_VERBS}') AND
  CASE WHEN trim(s1) <> '' OR l1 > level THEN l1 = level + 1 WHEN trim(s2) <> '' OR l2 > level THEN l2 = level + 1 END, false)),
runs AS (SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY line) AS run
  FROM (SELECT *, lag(level, 1, -1) OVER (PARTITION BY id ORDER BY line) AS before FROM l)),
w0 AS (SELECT id, conv_id, turn, level, run, list_filter(regexp_split_to_array(lower(string_agg(said, ' ' ORDER BY line)), '\s+'), lambda x: x <> '') AS w FROM runs GROUP BY id, conv_id, turn, level, run),
w1 AS (SELECT id, conv_id, turn, level, run, list_filter(regexp_split_to_array(lower(said), '\s+'), lambda x: x <> '') AS w FROM runs),
w AS (SELECT id, conv_id, turn, level, w FROM w0 WHERE level = 0 OR len(w) >= 5 UNION ALL SELECT id, conv_id, turn, 0, w FROM w1 WHERE level = 0 AND len(w) < 5
  UNION ALL SELECT w1.id, w1.conv_id, w1.turn, w1.level, w1.w FROM w1 JOIN w0 ON w0.id = w1.id AND w0.run = w1.run WHERE w0.level > 0 AND len(w0.w) < 5),
p AS (SELECT id, conv_id, turn, level, list_sort(list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) AS keys FROM w WHERE len(w) > 0),
said AS (SELECT conv_id, key, min(turn) AS origin FROM (SELECT conv_id, turn, unnest(keys) AS key FROM p WHERE level = 0) GROUP BY ALL),
k AS (SELECT conv_id, turn, level, keys, unnest(keys) AS key FROM (SELECT DISTINCT conv_id, turn, level, keys FROM p WHERE level > 0)),
found AS (SELECT k.conv_id, k.turn, k.level, k.keys, CASE WHEN s.origin < k.turn THEN s.origin END AS origin, count(*) AS n FROM k LEFT JOIN said s ON s.conv_id = k.conv_id AND s.key = k.key GROUP BY ALL),
passage AS (SELECT conv_id, turn, level, sum(n) AS n, coalesce(sum(n) FILTER (origin IS NOT NULL), 0) AS met, max({{'n': n, 'o': origin}}) FILTER (origin IS NOT NULL) AS best FROM found GROUP BY conv_id, turn, level, keys),
votes AS (SELECT conv_id, turn, CASE WHEN met >= 0.8 * n THEN best.o END AS origin, coalesce(sum(best.n) FILTER (level = 1), 0) AS direct, count(*) AS n, max(level) AS level FROM passage GROUP BY ALL),
linked AS (SELECT conv_id, turn, max({{'d': direct, 'o': origin}}) FILTER (origin IS NOT NULL AND direct > 0) AS best, sum(n) AS n_quoted,
  sum(CASE WHEN origin IS NOT NULL THEN n ELSE 0 END) AS n_linked, max(level) AS max_level FROM votes GROUP BY ALL),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m)),
own AS (SELECT id, regexp_replace(string_agg(raw, chr(10) ORDER BY line), '\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\z', '', 'g') AS text FROM l WHERE level = 0 GROUP BY id),
plain AS (SELECT m.conv_id, m.turn, m.role, coalesce(linked.best.o, turns.before) AS reply_to, coalesce(own.text, '') AS text,
  CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level
  FROM m JOIN turns ON turns.conv_id = m.conv_id AND turns.turn = m.turn LEFT JOIN linked ON linked.conv_id = m.conv_id AND linked.turn = m.turn LEFT JOIN own ON own.id = m.id)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY reply_to NULLS FIRST, turn, role NULLS FIRST, text, n_quoted) - 1 AS position FROM plain
"""


def licenses(least: float = 0.6, share: float = 0.2) -> str:
    """Every line of every document against every template, and the nearest directory above."""
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    words = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
WITH templates(template, license, text) AS (VALUES {values}),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({words.format("text")}) AS term FROM templates) GROUP BY ALL),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, '-'), doc_id // 1000, doc_id // 100, doc_id || '.txt') END AS path,
  CASE WHEN doc_id IS NOT NULL THEN concat_ws('/', coalesce(source, '-'), doc_id // 1000, doc_id // 100) END AS dir FROM documents),
size AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT k, unnest({words.format("text")}) AS term FROM d) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), size),
tv AS (SELECT template, license, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS part FROM tt JOIN idf USING (term)),
l AS (SELECT k, line, unnest({words.format("raw")}) AS term FROM (SELECT k, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM d)),
w AS (SELECT k, line, term, count(*) AS tf FROM l GROUP BY ALL),
v AS (SELECT k, line, term, tf, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM w LEFT JOIN idf USING (term), size),
s AS (SELECT k, line, sqrt(sum(w * w)) AS size, sum(tf) AS words FROM v GROUP BY ALL),
c AS (SELECT k, line, words, template, license, round(dot / size, 6) AS score
  FROM (SELECT k, line, template, license, sum(w * part) AS dot FROM v JOIN tv USING (term) GROUP BY ALL) JOIN s USING (k, line)),
b AS (SELECT k, line, words, max({{'s': score, 't': -template, 'l': license}}) AS best FROM c WHERE score >= {least} GROUP BY ALL),
o AS (SELECT k, max(best) AS best, sum(words) AS words FROM b GROUP BY ALL),
r AS (SELECT d.k, d.doc_id, path, dir, best.l AS license, best.s AS score, words, len({words.format("text")}) AS n FROM d LEFT JOIN o ON o.k = d.k),
g AS (SELECT dir AS above, score, license, path AS file FROM r WHERE license IS NOT NULL AND dir IS NOT NULL AND words >= {share} * n
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, license) = 1),
a AS (SELECT r.k, max({{'depth': length(above), 'l': g.license, 's': g.score, 'f': file}}) AS near FROM r JOIN g ON above = '' OR r.dir = above OR starts_with(r.dir, above || '/') GROUP BY ALL)
SELECT r.doc_id, r.path, coalesce(r.license, near.l) AS license, coalesce(r.score, near.s) AS score,
  CASE WHEN r.license IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN r.license IS NOT NULL THEN r.path ELSE near.f END AS license_path
FROM r LEFT JOIN a ON a.k = r.k
"""


ORACLE = {"op10_quotations": QUOTATIONS, "op6_licenses": licenses()}
