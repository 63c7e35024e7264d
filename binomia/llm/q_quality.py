"""Query of the quality classifier over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.quality import classify, fit


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return classify(docs, "text", fit(docs, "doc_id", "text", labels)).select("doc_id", "junk_score", "toxic_score", "keep")


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
