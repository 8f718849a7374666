"""DuckDB SQL for the queries that SQL can express."""

from tracetrim.llm.line_quality import BOILERPLATE, MARKS

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS written,
             regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length(regexp_replace(written, '<(\\*)\|', '<\\\1|', 'g')) + length(escaped))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Shares by weight, the excess over 3 times a source's size shared anew: sources by how soon they are full;
#: a source is full exactly when its cap is at most its share of what those fuller before it leave.
_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weight_left,
             sum(source_size) OVER () AS whole
      FROM r WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 3 * source_size <= weight * ((whole - full_before)::DOUBLE / weight_left::DOUBLE) AS is_full FROM o),
l AS (SELECT (max(whole) - coalesce(sum(3 * source_size) FILTER (WHERE is_full), 0))::DOUBLE
             / (sum(weight) FILTER (WHERE NOT is_full))::DOUBLE AS share FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * share END AS target FROM f, l),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - before)) AS a, greatest(0, least(size, floor(target)::BIGINT - source_size - before)) AS b2,
             greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - before)) AS c FROM b)
SELECT doc_id, size, source_size, target, (a + b2 + c)::BIGINT AS taken, ((a > 0)::INT + (b2 > 0)::INT + (c > 0)::INT)::BIGINT AS n_copies FROM k
"""

_WORD = r"[^\x20\x09-\x0D]+"

#: The rules line by line and passage by passage; words in windows of eight are counted by position.
_QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (SELECT r, unnest(range(len(ws) - 7)) AS i, unnest(list_transform(range(len(ws) - 7), lambda i: array_to_string(ws[i + 1 : i + 8], ' '))) AS k
        FROM w WHERE len(ws) >= 8),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) z WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n_repeat FROM twice, (SELECT unnest(range(8)) AS j) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
l2 AS (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again, regexp_extract_all(line, '{_WORD}') AS ws FROM l),
l3 AS (SELECT *, len(ws) AS n, len(regexp_extract_all(line, '\||»|›|•|·|::| > | / ')) AS seps,
              length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
              regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l2 WHERE len(ws) > 0),
p1 AS (SELECT *, i - row_number() OVER (PARTITION BY r ORDER BY i) AS para FROM l3),
p2 AS (SELECT *, lead(bare) OVER (PARTITION BY r, para ORDER BY i) AS below, max(length(bare)) OVER (PARTITION BY r, para) AS width,
              count(*) OVER (PARTITION BY r, para) AS tall FROM p1),
p3 AS (SELECT *, below IS NOT NULL AND NOT regexp_matches(bare, '[{MARKS}]["''”’»」』)\]]*$') AS goes_on,
              length(bare) + 1 + length(regexp_extract(below, '{_WORD}')) > width AS is_full FROM p2),
p4 AS (SELECT *, tall > 2 AND width <= 200 AND bool_and(NOT goes_on OR is_full) OVER (PARTITION BY r, para) AS wrapped FROM p3),
p5 AS (SELECT *, coalesce(lag(goes_on AND (wrapped OR regexp_matches(below, '^\p{{Ll}}'))) OVER (PARTITION BY r, para ORDER BY i), false) AS carried FROM p4),
p6 AS (SELECT *, sum(CASE WHEN carried THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS passage FROM p5),
p7 AS (SELECT r, passage, string_agg(line, ' ' ORDER BY i) AS said, sum(n) AS said_words FROM p6 GROUP BY r, passage),
p8 AS (SELECT r, passage, regexp_matches(said, '[{MARKS}]') AS marked, greatest(said_words, length(said) // 10) AS size,
              len(regexp_extract_all(said, '(?i){BOILERPLATE.pattern}')) AS phrases FROM p7),
l4 AS (SELECT p6.*, again OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 0.3 * n OR NOT marked
                 OR ((contains(line, '!!') OR contains(line, '??')) AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) >= n)
                 OR (seps >= 2 AND 8 * seps >= n)
                 OR (regexp_matches(line, '(?i){BOILERPLATE.pattern}') AND (size <= 20 OR 12 * phrases >= size)) AS bad
       FROM p6 JOIN p8 ON p8.r = p6.r AND p8.passage = p6.passage),
ls AS (SELECT r, count(*) AS n_lines, count_if(bad) AS n_bad_lines, count_if(again) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE NOT bad), 0) AS left_chars
       FROM l4 GROUP BY r),
c AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad_lines, 0)::BIGINT AS n_bad_lines,
             coalesce(left_chars, 0)::BIGINT AS left_chars
      FROM d JOIN w ON w.r = d.r LEFT JOIN covered ON covered.r = d.r LEFT JOIN ls ON ls.r = d.r)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars >= 0.5 * word_chars AS kept FROM c
"""

#: All pairs that share a shingle, counted; components by reachability.
_NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
k AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))
                                        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS ks FROM w),
s AS (SELECT doc_id, unnest(ks) AS shingle FROM k),
n AS (SELECT doc_id, len(ks)::BIGINT AS n FROM k),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT DISTINCT x AS a, x AS b FROM both_ways UNION SELECT a, y FROM reach JOIN both_ways ON x = b),
c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.m, n.doc_id) AS component_id, n.doc_id = coalesce(c.m, n.doc_id) AS kept FROM n LEFT JOIN c ON c.a = n.doc_id
"""

#: Masks of failures counted by part and label, then every order of the five letters.
_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
f AS (SELECT doc_id, part,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
      FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS way FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT way, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, way, step, n, good, toxic, fails[way[step]] AS own,
             len(list_filter(way[1:step - 1], lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS alone FROM s, m),
g AS (SELECT part, way, step,
             coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE gone AND own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE own AND alone), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (WHERE NOT gone AND own AND good), 0)::BIGINT AS good_lost,
             coalesce(sum(n) FILTER (WHERE NOT gone AND own AND toxic), 0)::BIGINT AS toxic_lost
      FROM r GROUP BY part, way, step)
SELECT part, array_to_string(list_transform(way, lambda j: 'ABCDE'[j]), '') AS filter_order, step::INTEGER AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, way[step]))::BIGINT AS shapley FROM g
"""

ORACLE: dict[str, str] = {"op1_chat_format": _CHAT, "op2_mix_sources": _MIX, "op9_line_quality": _QUALITY, "op10_minhash": _NEAR, "op12_filter_audit": _AUDIT}
