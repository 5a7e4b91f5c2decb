"""DuckDB SQL of the queries that SQL can express: same columns, same rows."""

from __future__ import annotations

import string

_LOWER = f"translate(COALESCE(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

HARD_NEGATIVES = """WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS aid, b.id AS bid, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
pos AS (SELECT aid, bid AS pid, score AS ps FROM s WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY aid ORDER BY score DESC, bid) <= 5)
SELECT aid AS anchor_id, pid AS positive_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY aid, pid ORDER BY score DESC, bid) AS INTEGER) AS rank,
  bid AS negative_id, ps AS positive_score, score AS negative_score
FROM pos JOIN s USING (aid) WHERE NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
QUALIFY rank <= 3"""

COLLOCATIONS = rf"""WITH p AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(string_split_regex({_LOWER}, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
total AS (SELECT lang, CAST(SUM(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, 1 AS size, UNNEST(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, UNNEST(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
  UNION ALL SELECT lang, 3, UNNEST(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, size, phrase, COUNT(*) AS c FROM g GROUP BY ALL HAVING COUNT(*) >= 10),
c AS (SELECT lang, size, phrase, c AS a, string_split(phrase, ' ') AS x FROM f WHERE size > 1),
inner2 AS (SELECT lang, a, UNNEST([x[1] || ' ' || x[2], x[2] || ' ' || x[3]]) AS phrase FROM c WHERE size = 3),
within2 AS (SELECT lang, phrase, MAX(a) AS within FROM inner2 GROUP BY lang, phrase),
kept AS (SELECT c.* FROM c LEFT JOIN within2 i USING (lang, phrase) WHERE i.within IS NULL OR 100 * i.within < 50 * c.a),
cuts AS (SELECT lang, phrase, a, 1 AS k, x[1] AS lp, CASE size WHEN 2 THEN x[2] ELSE x[2] || ' ' || x[3] END AS rp FROM kept
  UNION ALL SELECT lang, phrase, a, 2, x[1] || ' ' || x[2], x[3] FROM kept WHERE size = 3),
scored AS (SELECT cuts.lang, cuts.phrase, a, fl.c AS l, fr.c AS r,
    CAST((1000000::HUGEINT * a * a) // (fl.c::HUGEINT * fr.c) AS BIGINT) AS score
  FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = rp
  QUALIFY ROW_NUMBER() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1)
SELECT s.lang, ROW_NUMBER() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored s JOIN total USING (lang) QUALIFY rank <= 2000"""

COMPONENTS = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS x FROM d),
sized AS (SELECT doc_id, len(x) AS n, x FROM sets),
long AS (SELECT doc_id, n, UNNEST(x) AS shingle FROM sized),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM long a JOIN long b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sized UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, MIN(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, COUNT(*) AS n_links FROM links GROUP BY a)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, COALESCE(n_links, 0) AS n_links
FROM sized s JOIN least USING (doc_id) LEFT JOIN degree USING (doc_id)"""

CHAT = r"""WITH r AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\/')) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1 AS chars FROM r),
o AS (SELECT *, SUM(chars) OVER w AS stop, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY conv_id) AS n
  FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
t AS (SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS said,
    COALESCE(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
    SUM(CASE WHEN role = 'assistant' OR i = n THEN stop ELSE 0 END) AS written FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(written AS BIGINT) AS formatted_chars FROM t"""

ORACLE = {
    "op9_prefix_target_chat": CHAT,
    "op10_ngram_jaccard_join": COMPONENTS,
    "op11_misra_gries_collocations": COLLOCATIONS,
    "op13_cover_tree_negatives": HARD_NEGATIVES,
}
