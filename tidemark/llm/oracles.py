"""DuckDB SQL for the operators that SQL can express, by brute force."""

from tidemark.llm.chat import CHAT_SQL
from tidemark.llm.mixing import MIXING_SQL
from tidemark.llm.negatives import NEGATIVES_SQL
from tidemark.llm.prefixes import PREFIXES_SQL

#: Components by reachability over links(a, b) among nodes(v).
_REACH = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT v, v AS r FROM nodes UNION SELECT b, r FROM reach JOIN both_ways ON v = a),
least AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)"""

MINHASH_SQL = (
    r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
nodes AS (SELECT doc_id AS v, len(s)::BIGINT AS n FROM sets),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN nodes p ON p.v = a JOIN nodes q ON q.v = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
"""
    + _REACH
    + """
SELECT v AS doc_id, n AS n_shingles, component_id, v = component_id AS kept FROM nodes JOIN least USING (v)"""
)

REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT doc_id, i, md5(substr(hx, (2 * i + 1)::INT, 200)) AS g FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 99)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
bytes AS (SELECT doc_id, j, substr(hx, (2 * j + 1)::INT, 2) AS b FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2)) AS j FROM d)),
covered AS (SELECT b.doc_id, j, b, max(CASE WHEN i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY j ROWS 99 PRECEDING) AS gone FROM bytes b LEFT JOIN late l ON l.doc_id = b.doc_id AND l.i = b.j),
runs AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 THEN 1 ELSE 0 END AS opens FROM covered),
sums AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sum(opens)::BIGINT AS n_spans, string_agg(b, '' ORDER BY j) FILTER (gone = 0) AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)"""

EMBEDDINGS_SQL = (
    """
WITH RECURSIVE nodes AS (SELECT vec_id AS v, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT v, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM nodes WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.v AS a, q.v AS b FROM good p JOIN good q ON p.v < q.v AND len(p.u) = len(q.u) WHERE list_dot_product(p.u, q.u) >= 0.9),
"""
    + _REACH
    + """,
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v = component_id AS kept FROM nodes JOIN least USING (v) LEFT JOIN counts ON a = v"""
)

CLEANING_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, seq, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM d)),
dups AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY seq) AS r FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE r > 1 GROUP BY doc_id),
judged AS (SELECT doc_id, seq, lw, list_sum(list_transform(lw, lambda x: len(x))) AS chars, len(lw) > 0 AND (
    len(line) - len(translate(line, '#*$%&|<>', '')) > 0.1 * len(line)
    OR (len(line) - len(replace(line, '!! ', ''))) // 3 + (len(line) - len(replace(line, '?? ', ''))) // 3 + regexp_matches(line, '(!!|\?\?)[\x20\x09-\x0D]*$')::INT > 0.3 * len(lw)
    OR (len(lw) >= 4 AND len(list_filter(lw, lambda x: x = upper(x) AND x <> lower(x))) > 0.7 * len(lw))
    OR (len(regexp_extract_all(line, '[\x20\x09-\x0D][|>»·•/][\x20\x09-\x0D]')) >= 2 AND len(regexp_extract_all(line, '[\x20\x09-\x0D][|>»·•/][\x20\x09-\x0D]')) * 8 >= len(lw))
    OR (len(line) - len(replace(line, '://', ''))) // 3 + (len(line) - len(replace(line, 'www.', ''))) // 4 > 0.3 * len(lw)
    OR (len(lw) BETWEEN 3 AND 30 AND len(regexp_extract_all(line, '[0-9][^\x20\x09-\x0D]*')) > 0.6 * len(lw))
    OR (len(lw) <= 30 AND regexp_matches(line, '(?i)all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|copyright|licensed under|permission is hereby granted|subscribe (to|now)|sign (in|up)|log ?in\b|click here|read more|share (this|on)|follow us|skip to (main )?content|powered by'))
    OR (len(lw) >= 20 AND 4 * len(list_distinct(lw)) < len(lw))) AS failed FROM lines),
named AS (SELECT doc_id, chars, failed, len(lw) AS n, name, coalesce(lag(name, 3) OVER w, lag(name, 2) OVER w, lag(name) OVER w) AS before,
  coalesce(lead(name, 3) OVER w, lead(name, 2) OVER w, lead(name) OVER w) AS after FROM (SELECT *, regexp_replace(array_to_string(lw, ' '), '[0-9]+', '0', 'g') AS name FROM judged WHERE len(lw) > 0) WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
stock AS (SELECT name FROM named WHERE NOT failed AND n BETWEEN 3 AND 30 AND doc_id IN (SELECT min(doc_id) FROM d GROUP BY text) GROUP BY name
  HAVING (count(DISTINCT before) >= 50 AND 100 * count(DISTINCT before) >= 80 * count(before)) OR (count(DISTINCT after) >= 50 AND 100 * count(DISTINCT after) >= 80 * count(after))),
ruled AS (SELECT doc_id, chars, failed OR (n BETWEEN 3 AND 30 AND name IN (SELECT name FROM stock)) AS failed FROM named),
sums AS (SELECT doc_id, count(*) FILTER (failed) AS n_lines_removed, coalesce(sum(chars) FILTER (NOT failed), 0) AS left_chars FROM ruled GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, (len(text) - len(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(left_chars, 0) AS left_chars
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN sums USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - left_chars::DOUBLE / word_chars ELSE 0.0::DOUBLE END AS lost FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, lost, NOT base_failed AND lost <= 0.5 AS kept FROM v"""

ORACLES = {"op2_embeddings": EMBEDDINGS_SQL, "op5_mixing": MIXING_SQL, "op6_cleaning": CLEANING_SQL, "op8_repeats": REPEATS_SQL, "op10_minhash": MINHASH_SQL, "op11_chat": CHAT_SQL, "op12_negatives": NEGATIVES_SQL, "op13_prefixes": PREFIXES_SQL}
