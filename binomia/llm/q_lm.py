"""Query of the LM scorer over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm.lm import score


def op1_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return score(docs.withColumn("held", remainder == 0), "doc_id", "text", "held")


QUERIES = {"op1_lm_trie": op1_lm_trie}
ORACLES: dict[str, str] = {}
