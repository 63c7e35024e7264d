"""Query of the SimHash operator over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.simhash import near_duplicates


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, "doc_id", "text", shingle=4, k=4)


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
