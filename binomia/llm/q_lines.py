"""Query of the line dedup operator over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm.linededup import drop_frequent_lines

ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT r, doc_id, lines, list_transform(lines, lambda x: trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) AS keys FROM d),
e AS (SELECT DISTINCT r, unnest(keys) AS key FROM k),
f AS (SELECT key FROM e WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
p AS (SELECT r, doc_id, unnest(lines) AS line, unnest(keys) AS key, unnest(range(len(lines))) AS pos FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM p LEFT JOIN f USING (key) GROUP BY r, doc_id
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_frequent_lines(docs, "doc_id", "text", threshold=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": ORACLE}
