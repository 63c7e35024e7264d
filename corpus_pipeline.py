"""The corpus pipeline: documents to packed training sequences in five stages, each on all that the one before kept.

quality: documents that the classifier rejects as junk or toxic go. line_dedup: lines found in at least 10 different
texts go from all but the first of them. simhash: of documents whose fingerprints link, one stays. mix: documents as the
mix takes them, once for each pass they are drawn in, with the words of their drawn blocks. pack: their pieces in
sequences of at most 1024 tokens. All but the last return the columns of documents.

Cases, for every stage: a null in any column is a value (a null text counts as empty, a null source is a source, a null id has no
label); an empty text passes the first three stages and isn't drawn by the mix; very long texts are read whole; repeated rows are
rows each until simhash, which keeps one of them; of a group the row with the least place in its input stays; an empty table gives an
empty one; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm import linededup, mixing, packing, quality, simhash
from binomia.llm.common import written
from binomia.llm.q_packing import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    docs = docs.select(*COLUMNS)
    return quality.classify(docs, "text", quality.fit(docs, "doc_id", "text", labels)).where("keep").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.drop_frequent_lines(docs, "doc_id", "text", threshold=10, by_text=True, keep_first=True, carry=("lang", "source"))
    return _documents(out.withColumn("text", F.col("kept")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    stays = simhash.near_duplicates(rows, "_row", "text", shingle=4, k=4).where("_row = component_id").select("_row")
    return rows.join(stays, "_row", "left_semi").select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(mixing.mixed_texts(docs.select(*COLUMNS), "text", "source"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, "doc_id", "text", vocabulary(), size=1024, end_id=2)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: Models, fingerprints and tokenizers are beyond SQL; tests/llm/test_pipeline.py has plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
