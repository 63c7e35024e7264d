"""Query of the packaged WARC operator over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.zipwarc import round_trip

ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM k GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM k JOIN f USING (payload_digest)
"""


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op2_warc_zip": op2_warc_zip}
ORACLES = {"op2_warc_zip": ORACLE}
