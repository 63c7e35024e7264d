"""The cluster's shared folder, and tables in it that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL = 64 << 20  # bytes a core, under which a table is dealt over all cores


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, on one machine a new one is set; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is None and held.isDefined():
        found = held.get()
    if found is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="binomia-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/binomia/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows doesn't compute it twice, and a lost executor doesn't either."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.binomia_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a frame made by written(); it must not be read afterwards."""
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.binomia_path)
    p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by key where it is small: such a file may be one row group, which one task reads. A large table has splits enough and stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * SMALL else df
