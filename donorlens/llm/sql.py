"""DuckDB SQL of the longer queries."""

#: Byte-wise crc32 of a text column: a table ``crc(t)`` of the 256 steps, made by the polynomial's rule.
CRC_TABLE = """crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i))"""


def crc32(text: str) -> str:
    """SQL of the unsigned crc32 of ``text``'s UTF-8 bytes; needs ``t`` of CRC_TABLE in scope."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295],
    list_transform(range(1, octet_length(encode({text})) + 1), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k - 1 AS INTEGER), 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""


TARGET_RESAMPLING = rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
split AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT side, doc_id, unnest(w) AS x FROM split),
bucket AS (SELECT x, {crc32('x')} % 10000 AS k FROM (SELECT DISTINCT x FROM words) CROSS JOIN crc),
counts AS (
  SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN bucket USING (x) GROUP BY k),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT k, floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS gain FROM counts CROSS JOIN totals),
weights AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN bucket USING (x) JOIN gains USING (k) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
named AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS name, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
damage AS (SELECT key, {crc32('key')} % 20 AS kind FROM (SELECT DISTINCT key FROM named) CROSS JOIN crc),
damaged AS (
  SELECT name, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM named JOIN damage USING (key)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS ini,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
facts AS (
  SELECT *, body = '' AS blank, row_number() OVER (PARTITION BY name, role, text ORDER BY i) > 1 AS again,
    right(body, 1) NOT IN ('.', '!', '?') AS cut, lag(ini) OVER (PARTITION BY name ORDER BY i) AS before FROM placed),
rows_of AS (
  SELECT *, blank OR again AS must_go, NOT blank AND NOT again AND cut AS truncated,
    before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au') AS illegal FROM facts),
inserts(st, mid, n, lines) AS (VALUES
  ('0', '0', 0, ''), ('0', 'u', 1, chr(10) || 'user:'), ('0', 'a', 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 's', 0, ''), ('s', 'u', 1, chr(10) || 'user:'), ('s', 'a', 2, chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', 'u', 0, ''), ('u', 'a', 1, chr(10) || 'assistant:'), ('a', 'a', 0, ''), ('a', 'u', 1, chr(10) || 'user:')),
edits(mid, edit, ini, st, role, cost) AS (VALUES
  ('0', 'K', 's', 's', '', 0), ('0', 'K', 'u', 'u', '', 0), ('s', 'K', 'u', 'u', '', 0), ('a', 'K', 'u', 'u', '', 0), ('u', 'K', 'a', 'a', '', 0),
  ('0', 'R', '', 'u', 'user', 3), ('s', 'R', '', 'u', 'user', 3), ('a', 'R', '', 'u', 'user', 3), ('u', 'R', '', 'a', 'assistant', 3),
  ('0', 'D', '', '0', '', 4), ('s', 'D', '', 's', '', 4), ('u', 'D', '', 'u', '', 4), ('a', 'D', '', 'a', '', 4)),
paths(name, i, st, best) AS (
  SELECT DISTINCT name, CAST(0 AS BIGINT), '0', {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} FROM named
  UNION ALL
  SELECT p.name, r.i, e.st, min({{'cost': p.best.cost + CAST(3 * n.n + e.cost + CASE WHEN r.truncated AND e.edit <> 'D' THEN 3 ELSE 0 END AS BIGINT),
    'audit': p.best.audit || repeat('I', n.n) || e.edit,
    'lines': p.best.lines || n.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || e.role || ':' || r.text ELSE chr(10) || r.role || ':' || r.text END}})
  FROM paths p JOIN rows_of r ON r.name = p.name AND r.i = p.i + 1 JOIN inserts n ON n.st = p.st JOIN edits e ON e.mid = n.mid
  WHERE e.edit = 'D' OR (NOT r.must_go AND (e.edit = 'R' OR e.ini = r.ini))
  GROUP BY p.name, r.i, e.st),
totals AS (
  SELECT name, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM rows_of GROUP BY name),
ended AS (
  SELECT p.name, min({{'cost': p.best.cost + CAST(3 * n.n AS BIGINT), 'audit': p.best.audit || repeat('I', n.n), 'lines': p.best.lines || n.lines}}) AS best
  FROM paths p LEFT JOIN totals t ON t.name = p.name JOIN inserts n ON n.st = p.st
  WHERE p.i = coalesce(t.n, 0) AND n.mid IN ('0', 'a') GROUP BY p.name)
SELECT DISTINCT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
FROM named JOIN ended USING (name) LEFT JOIN totals USING (name)
"""
