"""Query of the nearest-neighbour operator over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm.ann import nearest_neighbours


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(rows, "vec_id", "embedding", lambda i: F.pmod(i, F.lit(100)) == 0, k=10)


QUERIES = {"op4_nn_descent": op4_nn_descent}
ORACLES: dict[str, str] = {}
