"""Query of the mixing operator over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.mixing import mix


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mix": op7_mix}
ORACLES: dict[str, str] = {}
