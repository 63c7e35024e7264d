"""Query of the n-gram Jaccard join over documents, and the same by an inverted index in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.jaccard import jaccard_components

ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, t.b FROM reach r JOIN twoway t ON t.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN least USING (doc_id)
"""


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, "doc_id", "text", n=5, percent=80)


QUERIES = {"op11_jaccard": op11_jaccard}
ORACLES = {"op11_jaccard": ORACLE}
