"""Query of the conversation repair operator, and the same as a recursion over rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.dialogue import repair

ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))) AS name FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(name)), lambda i: ('0x' || substr(hex(name), 2 * i::BIGINT + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS initial, trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare, lag(substr(role, 1, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS (
  SELECT conv_id, pos, turn, role, text, initial, before, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS x(state, initial, next)),
wanted AS (SELECT * FROM (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)) AS x(state, role, next)),
puts AS (
  SELECT state, state AS next, '' AS letters, '' AS lines, 0 AS cost FROM wanted
  UNION ALL SELECT state, next, 'I', role || ':' || chr(10), 2 FROM wanted
  UNION ALL SELECT x.state, y.next, 'II', x.role || ':' || chr(10) || y.role || ':' || chr(10), 4 FROM wanted x JOIN wanted y ON x.next = y.state WHERE x.state <> y.next),
moves AS (
  SELECT conv_id, pos, state, state AS next, 'D' AS letter, '' AS line, 3 AS cost FROM faulty, wanted
  UNION ALL SELECT conv_id, pos, state, next, 'K', role || ':' || text || chr(10), (fault = 'truncated')::INT FROM faulty JOIN steps USING (initial) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, pos, state, next, 'R', w.role || ':' || text || chr(10), 2 + (fault = 'truncated')::INT FROM faulty f, wanted w WHERE fault IN ('', 'truncated')),
arcs AS (SELECT conv_id, pos, p.state, m.next, p.letters || m.letter AS letters, p.lines || m.line AS lines, p.cost + m.cost AS cost FROM moves m JOIN puts p ON p.next = m.state),
walks AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': ''} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, a.pos, a.next, min({'cost': w.best.cost + a.cost, 'audit': w.best.audit || a.letters, 'lines': w.best.lines || a.lines})
  FROM walks w JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.pos = w.pos + 1 AND a.state = w.state GROUP BY w.conv_id, a.pos, a.next),
ended AS (
  SELECT c.conv_id, min({'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.letters, 'lines': w.best.lines || p.lines}) AS best
  FROM counted c JOIN walks w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n JOIN puts p ON p.state = w.state WHERE p.next = 3 OR (p.next = 0) GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.lines, 1, length(e.best.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES = {"op12_dialogue": op12_dialogue}
ORACLES = {"op12_dialogue": ORACLE}
