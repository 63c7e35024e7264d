"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal text form a group. Small groups are gathered by hash into bundles, a fixed number for
each shard; a group beyond a bundle's share of bytes, tokens or rows is dealt into parts by row, so a
text that holds a third of all rows spreads over many shards. Each bundle, heaviest first, goes to the
shard where the dot product of its vector with the shard's residual capacity is highest. Only sums of
bundles reach the driver: at most `per_shard` bundles a shard and, as each large group takes more than a
bundle's share of one of three totals, 6 * shards * per_shard parts, whatever the input.

Cases: a null text counts no bytes and groups with the empty text; repeated rows are placed each; a null
id is a value like any other; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binomia.llm.common import WORD_RX, written

ROW_BYTES = 16
SLOT_ROWS = 50_000


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = (4.0, 1.0, 1.0)) -> np.ndarray:
    """The shard of each vector, heaviest first, where the dot product with the residual capacity is highest.

    items: one row a bundle; each dimension is taken as a share of a shard's capacity. weights: of the dimensions in the product.
    """
    share = items / np.maximum(items.sum(0), 1e-300) * shards
    scaled = share * np.sqrt(np.asarray(weights) / sum(weights))
    left = np.tile(np.sqrt(np.asarray(weights) / sum(weights)), (shards, 1))
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-scaled.max(1), kind="stable"):
        k = int(np.argmax(left @ scaled[i]))
        out[i] = k
        left[k] -= scaled[i]
    return out


def shard_documents(df: DataFrame, id_col: str, text_col: str, shards: int = 40, per_shard: int = 256) -> DataFrame:
    """(id, size, text_crc32, shard, slot): sizes near equal over shards; slots without gaps from 0 in each shard."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD_RX)).cast("long").alias("tokens"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(7), text).alias("g2"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    sums = [max(1, x or 0) for x in total]
    bundles = shards * per_shard
    share = [x / bundles for x in sums]
    per = [F.col(c) / F.lit(float(s)) for c, s in zip(("size", "tokens", "n"), share, strict=True)]
    large = (
        rows.groupBy("g1", "g2").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        .withColumn("parts", F.least(F.ceil(F.greatest(*per)), F.col("n")).cast("int"))
        .where(F.greatest(*per) > 1)
        .select("g1", "g2", "parts")
    )
    # at most 3 * bundles rows: each large group holds more than a bundle's share of one of three totals
    keyed = rows.join(F.broadcast(large), ["g1", "g2"], "left").select(
        "id", "size", "text_crc32", "tokens",
        F.when(F.col("parts").isNull(), F.pmod("g1", F.lit(bundles))).otherwise(F.xxhash64("g1", "g2", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")))).alias("bundle"),
        F.col("parts").isNotNull().alias("big"),
    )
    keyed = written(keyed, "shard-keyed")
    found = keyed.groupBy("bundle", "big").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("big", "bundle").collect()
    at = place(np.array([list(r)[2:] for r in found], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(r[0], r[1], int(s)) for r, s in zip(found, at, strict=True)], "bundle long, big boolean, shard int")
    subs = max(1, -(-total[2] // (shards * SLOT_ROWS)))
    out = keyed.join(F.broadcast(placed), ["bundle", "big"]).withColumn("sub", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(subs)))
    counts = out.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "sub").orderBy("id", "text_crc32", "size")
    return (
        out.withColumn("rank", F.row_number().over(own)).join(base, ["shard", "sub"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
    )
