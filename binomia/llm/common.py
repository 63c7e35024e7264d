"""Shared helpers: the cluster's shared folder, tables that cut lineage, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space and non-space of all contracts: the six ASCII characters.
SPACE = "\\x20\\x09-\\x0D"
WORD_RX = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, on one machine (as in tests) a new one is set; on a cluster it must be set."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        held = jsc.getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="binomia-")
        spark.sparkContext.setCheckpointDir(found)
        held = jsc.getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/binomia/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends at files all executors see."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.binomia_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a frame made by written(); it must not be read afterwards."""
    path = getattr(df, "binomia_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, n + 1 offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def spans(offsets: np.ndarray, at_most: int):
    """Row ranges whose bytes come to at_most, or single longer rows."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + at_most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def release() -> None:
    """Gives memory that large arrays have left to the system; a reused Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
