"""Query of the packing operator over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binomia.llm.packing import pack_documents


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, "doc_id", "text", vocabulary(), size=1024, end_id=2)


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
