"""DuckDB statements for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

# Part of a URL after the first "://", up to its end; empty without one.
_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_HOST = (f"translate(regexp_extract({_REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         "'abcdefghijklmnopqrstuvwxyz')")

OP1 = f"""
WITH parts AS (
  SELECT page_id, coalesce({_HOST}, '') AS host,
         coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract({_REST}, '^[^?#]*\\?([^#]*)', 1), '') AS query
  FROM pages),
named AS (
  SELECT page_id, host, path,
         regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> ''
               AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS params FROM parts)),
rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, host, path, canonical, max_by(r_host || r_path, length(r_host || r_path)) AS rule,
         max_by(r_verdict, length(r_host || r_path)) AS decided
  FROM named LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id, host, path, canonical),
listed AS (SELECT DISTINCT canonical AS entry FROM named WHERE regexp_matches(host, 'spam|pills'))
SELECT page_id, host, path, rule,
       coalesce(decided, CASE WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical,
       rule IS NULL AND entry IS NOT NULL AS listed
FROM best LEFT JOIN listed ON entry = canonical
"""

OP5 = """
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.row <> c.row)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'),
                   (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
sized AS (
  SELECT *, length('<|im_start|>') + length('<|im_end|>') + 2 + length(role) + length(text)
         + len(regexp_extract_all(text, '<\\*\|(im_start|im_end)\|>')) AS shown
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_SYMBOLS = "len(regexp_extract_all({0}, '[#*$%&|<>]'))"
_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_WORD_CHARS = "length(regexp_replace({0}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_BYTES = "strlen(regexp_replace({0}, '[\\x20\\x09-\\x0D]+', '', 'g'))"
_STOCK = (
    "all rights reserved|accept (all )?cookies|uses? cookies|cookie policy|privacy policy|terms of (use|service)"
    "|enable javascript|javascript is (required|disabled)|subscribe to our newsletter|click here|read more$"
    "|share (this )?on (facebook|twitter)|lorem ipsum|log ?in or register|skip to content")

OP6 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT row, doc_id, text, {_WORDS.format('text')} AS words, string_split(text, chr(10)) AS lines FROM docs),
grams AS (
  SELECT row, i, list_slice(words, i, i + 4) AS gram, count(*) OVER (PARTITION BY row, list_slice(words, i, i + 4)) AS n
  FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM measured)),
repeated AS (
  SELECT row, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT row, unnest(range(i, i + 5)) AS place FROM grams WHERE n > 1) GROUP BY row),
line_rows AS (
  SELECT row, line, {_WORDS.format('line')} AS words, {_SYMBOLS.format('line')} AS symbols, {_BYTES.format('line')} AS bytes
  FROM (SELECT row, unnest(lines) AS line FROM measured)),
judged AS (
  SELECT row, line, words, bytes, len(words) > 0 AND (
    (len(list_filter(words, lambda w: w IN ('|', '>', '»', '›', '·', '•'))) >= 2
     AND len(list_filter(words, lambda w: w IN ('|', '>', '»', '›', '·', '•'))) >= 0.15::DOUBLE * len(words))
    OR NOT regexp_matches(line, '[\\pL\\pN]') OR symbols > 0.08::DOUBLE * bytes
    OR (len(words) <= 25 AND regexp_matches(line, '{_STOCK}', 'i'))) AS fails
  FROM line_rows),
per_doc AS (
  SELECT row, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(bytes) FILTER (fails), 0) AS lost, sum(bytes) AS total,
         count(*) FILTER (len(words) > 0) - count(DISTINCT line) FILTER (len(words) > 0) AS n_dup_lines
  FROM judged GROUP BY row),
based AS (
  SELECT doc_id, len(words) AS n_words, {_WORD_CHARS.format('text')} AS word_chars, {_SYMBOLS.format('text')} AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost, total, n_failed_lines
  FROM measured JOIN per_doc USING (row) LEFT JOIN repeated USING (row))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.4::DOUBLE * total AS kept,
       n_failed_lines::BIGINT AS n_failed_lines
FROM based
"""

# CRC-32, a byte at a time: the reflected polynomial of the standard.
_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: "
        "list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
_SHOWN = "coalesce({0}::VARCHAR, ' ')"

OP11 = f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format(f"({_SHOWN.format('conv_id')} || ':' || {_SHOWN.format('turn')})")} % 20 AS fault
  FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         substr(role, 1, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open
  FROM rows),
marked AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS late,
         lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS following
  FROM placed),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (late) AS duplicate, count(*) FILTER (open AND NOT blank AND NOT late) AS truncated,
         count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM marked GROUP BY conv_id),
given(q, role, after) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
put(q, letters, cost, p) AS (
  SELECT q, '', 0, q FROM given
  UNION ALL SELECT q, 'I', 3, after FROM given
  UNION ALL SELECT a.q, 'II', 6, b.after FROM given a JOIN given b ON a.after = b.q),
edits(p, letter, cost, after, initial) AS (
  SELECT q, 'D', 4, q, NULL FROM given
  UNION ALL SELECT q, 'R', 3, after, NULL FROM given
  UNION ALL SELECT q, 'K', 0, after, role FROM given
  UNION ALL VALUES (0, 'K', 0, 1, 's')),
moves AS (
  SELECT q, letters || letter AS letters, put.cost + edits.cost AS cost, after, initial, letter FROM put JOIN edits USING (p)),
search(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM faults
  UNION ALL
  SELECT s.conv_id, s.i + 1, e.after,
         min({{'cost': s.best.cost + e.cost + CASE WHEN open AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': s.best.audit || letters}})
  FROM search s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1 JOIN moves e ON e.q = s.q
  WHERE letter = 'D' OR NOT (blank OR late) AND (letter = 'R' OR e.initial = m.initial)
  GROUP BY s.conv_id, s.i, e.after),
solved AS (
  SELECT s.conv_id, min({{'cost': s.best.cost + put.cost, 'audit': s.best.audit || letters}}) AS best
  FROM search s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.i JOIN put ON put.q = s.q AND put.p IN (0, 3)
  GROUP BY s.conv_id),
letters AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, unnest(range(length(best.audit))) AS spot,
         length(replace(best.audit, 'D', '')) AS stay
  FROM solved WHERE best.audit <> ''),
counted AS (
  SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS stayed
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
repaired AS (
  SELECT c.conv_id, string_agg(CASE WHEN letter = 'K' THEN m.role WHEN (stay - stayed) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || CASE WHEN letter = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY spot) AS whole
  FROM counted c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.i = c.i AND letter <> 'I'
  WHERE letter <> 'D' GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP12 = """
WITH sound AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row AS anchor_row, a.vec_id AS anchor_id, r.row, r.vec_id, r.label = a.label AS alike,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 100 = 0 AND a.row <> r.row),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id, row) AS place
  FROM scored WHERE alike QUALIFY place <= 5),
fits AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_row, p.place ORDER BY n.score DESC, n.vec_id, n.row) AS rank
  FROM positives p JOIN scored n ON n.anchor_row = p.anchor_row AND NOT n.alike
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM fits WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_url_filters": OP1,
    "op5_exact_top_k": OP5,
    "op6_quality_rules": OP6,
    "op9_chat_formatting": OP9,
    "op11_turn_repair": OP11,
    "op12_hard_negatives": OP12,
}
