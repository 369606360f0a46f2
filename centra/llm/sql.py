"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, grams.n AS n, item_id FROM grams JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, trim(line, {SPACE}) AS t, count(DISTINCT doc_id) AS pages FROM l GROUP BY ALL),
n AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT c.source, t FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE t <> '' AND pages >= 3 AND pages > 0.08 * total),
k AS (SELECT doc_id, i, line, bad.t IS NULL AS kept FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(line, {SPACE}) = bad.t)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (kept) AS t FROM k GROUP BY doc_id) USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
f AS (SELECT doc_id, source, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM base GROUP BY source),
p AS (SELECT sum(x) / sum(n) AS mean, var_pop(x / n) - sum(x) / sum(n) * (1 - sum(x) / sum(n)) * avg(1 / n) AS beyond FROM h),
q AS (SELECT mean, CASE WHEN beyond > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / beyond - 1)) ELSE 1e6 END AS weight FROM p),
v AS (SELECT source, (x + mean * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, round(rate, 9) AS host_rate
FROM base JOIN v ON base.source IS NOT DISTINCT FROM v.source
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
often AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN often USING (g)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP5 = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(<SYS>>|</SYS>>|/INST\]|/ROLE\]|INST\]|ROLE\]|/s>|s>)', '\1\\\2\3', 'g')) AS body,
             length(regexp_replace(role, '([<\[])(\\*)(<SYS>>|</SYS>>|/INST\]|/ROLE\]|INST\]|ROLE\]|/s>|s>)', '\1\\\2\3', 'g')) AS named FROM c),
m AS (SELECT *, CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('  </s>') WHEN 'system' THEN length('<<SYS>><</SYS>>') + 4 ELSE length('[ROLE][/ROLE][/ROLE]') + 2 + named END AS marks FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + marks)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

SQL = {"op1_decontaminate": OP1, "op4_substring_dedup": OP4, "op5_chat": OP5, "op6_line_dedup": OP6, "op9_quality_rules": OP9}
