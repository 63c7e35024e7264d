"""Query of the spelling variant operator over documents, and the same by deletion neighbourhoods in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.spelling import group_spellings

ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
held AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, list_transform(range(octet_length(encode(concat(doc_id, ':', run)))), lambda i: ('0x' || substr(hex(encode(concat(doc_id, ':', run))), 2 * i::BIGINT + 1, 2))::BIGINT) AS b FROM held),
summed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
made AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM places),
pairs AS (
  SELECT x.word AS a, y.word AS b, y.n AS b_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.rest = y.word),
best AS (SELECT a AS word, count(*) AS n_near, min({'less': -b_n, 'form': b}) AS top FROM pairs GROUP BY a),
near AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * n THEN top.form END AS form, CASE WHEN -top.less >= 10 * n THEN -top.less END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, coalesce(form, word) AS stop, 1 AS step FROM near
  UNION ALL SELECT w.word, f.form, step + 1 FROM walk w JOIN near f ON f.word = w.stop WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(stop, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM near JOIN roots USING (word)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_spellings(docs, "doc_id", "text", modulus=31, least=7, often=2, ratio=10)


QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {"op13_spelling": ORACLE}
