"""Mixing sources to target weights by blocks.

The words of each source, its rows in a pseudorandom order, form a stream cut into blocks of fixed length. Sources
share the mix by weight; a target stops at `repeats` times its source and the excess is shared again. The slots of
the mix are dealt over output shards; each shard draws a multinomial of sources over the quotas still open, so
that all shards together meet every quota. A source's j-th slot takes block perm(j) of its j // blocks-th pass, a
keyed Feistel permutation of the block numbers, and slots join blocks by that index. A text's share of the
mix is the words of its blocks that were drawn.

Only a row a source and a count a (shard, source) reach the driver; there are fewer shards where sources are many, so
that the counts stay within MAX_COUNTS, or one a source.

Cases: a null or empty text has no words and nothing taken; a null source is a source, the last in order; a null id
is a value like any other; rows that repeat are told apart by their place in the stream; an empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binomia.llm.common import WORD_RX, written

BLOCK = 64
SHARD_SLOTS = 1 << 16
MAX_SHARDS = 4096
MAX_COUNTS = 1 << 22
FEW_SOURCES = 50_000  # a broadcast's bound
BUCKET_ROWS = 20_000
SEED = 20_240_501


def targets(sizes: list[int], weights: list[float], share: float, repeats: float) -> list[float]:
    """Words of each source: share * sum(sizes) by weight, none above repeats times its size."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i, n in enumerate(sizes) if n]
    while free:
        whole = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / whole > repeats * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in above:
            out[i] = repeats * sizes[i]
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in above]
    return out


def draw(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by (shard, source): each shard a multinomial over the quotas still open; columns add up to the quotas."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, out = quotas.astype(np.int64).copy(), np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        slots = int(left.sum()) // (shards - k)
        while slots > 0:
            got = np.minimum(rng.multinomial(slots, left / left.sum()), left)
            out[k] += got
            left -= got
            slots -= int(got.sum())
    return out


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of range(n), chosen by key, takes j: a Feistel network, walked until within n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = j.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(6):
            x = (right + np.uint64((key * 31 + r * 0x9E37 + 1) & 0xFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def block_length(size: int, block: int = BLOCK) -> int:
    """Small sources get shorter blocks, so that a quota of whole blocks stays near their target."""
    return max(1, min(block, size // 512))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, repeats: int = 2, block: int = BLOCK) -> DataFrame:
    """(id, th, size, source_size, target, taken, drawn): a row a text; th: its text's hash; drawn: an array of
    (start, stop, copies), the word ranges of the text in drawn blocks, null where nothing or all of it was taken `repeats` times."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("th"), F.regexp_count(text, F.lit(WORD_RX)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")),
        "mix-rows",
    )
    by_source = rows.groupBy("source").agg(F.sum("size"), F.count("*")).orderBy(F.asc_nulls_last("source")).collect()
    sizes = [r[1] for r in by_source]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, repeats)
    lengths = [block_length(n, block) for n in sizes]
    blocks = [-(-n // b) for n, b in zip(sizes, lengths, strict=True)]
    quotas = np.array([min(repeats * k, round(t * k / n)) if n else 0 for n, k, t in zip(sizes, blocks, aims, strict=True)], np.int64)
    shards = int(max(1, min(MAX_SHARDS, -(-int(quotas.sum()) // SHARD_SLOTS), MAX_COUNTS // max(1, len(sizes)))))
    counts = draw(quotas, shards, SEED)
    firsts = np.cumsum(counts, axis=0) - counts
    jobs = [(k, s, int(firsts[k, s]), int(counts[k, s]), blocks[s]) for k in range(shards) for s in range(len(sizes)) if counts[k, s]]
    if not jobs:
        empty = F.lit(None).cast("array<struct<start:bigint,stop:bigint,copies:bigint>>")
        return rows.select(F.col("id").alias(id_col), "th", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), empty.alias("drawn"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, first, n, total in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                j = np.arange(first, first + n)
                at = np.empty(n, np.int64)
                for turn in range(first // total, (first + n - 1) // total + 1):
                    own = j // total == turn
                    at[own] = permuted(j[own] % total, total, SEED + 1009 * s + turn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s), pa.int32()), pa.array(at)], names=["s", "block"])

    piece = F.least(F.lit(SHARD_SLOTS), F.col("n") - F.col("k") * SHARD_SLOTS)
    dealt = (
        spark.createDataFrame(jobs, "shard int, s int, first long, n long, total long").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SHARD_SLOTS).cast("long"))))
        .select("s", (F.col("first") + F.col("k") * SHARD_SLOTS).alias("first"), piece.cast("long").alias("n"), "total").repartition(max(shards, spark.sparkContext.defaultParallelism))
    )
    taken = dealt.mapInArrow(slots, "s int, block long").groupBy("s", "block").agg(F.count("*").alias("copies"))

    info = spark.createDataFrame([(r[0], i, sizes[i], float(aims[i]), lengths[i], i + 1) for i, r in enumerate(by_source)], f"source {rows.schema['source'].dataType.simpleString()}, s int, source_size long, target double, length long, one int")
    known = info.withColumnRenamed("source", "name")
    n_rows = sum(r[2] for r in by_source)
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    known = F.broadcast(known) if len(sizes) <= FEW_SOURCES else known
    placed = rows.join(known, rows["source"].eqNullSafe(known["name"])).drop("source", "name", "one").withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "id", "th", F.when(F.col("size") == 0, F.col("row"))), F.lit(buckets)))
    placed = written(placed, "mix-placed")
    per = placed.groupBy("s", "bucket").agg(F.sum("size").alias("held"))
    base = per.select("s", "bucket", (F.sum("held").over(Window.partitionBy("s").orderBy("bucket")) - F.col("held")).alias("base"))
    own = Window.partitionBy("s", "bucket").orderBy(F.xxhash64("id", "th"), "id", "th", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("start", F.sum("size").over(own) - F.col("size")).join(base, ["s", "bucket"]).withColumn("start", F.col("start") + F.col("base"))
    first, last = F.floor(F.col("start") / F.col("length")).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / F.col("length")).cast("long")
    spread = laid.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(-1 - F.col("row")))))  # no block, and no common key
    low = F.greatest(F.col("block") * F.col("length") - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * F.col("length") - F.col("start"), F.col("size"))
    drawn = spread.join(taken.hint("merge"), ["s", "block"], "left").withColumns({"low": low, "high": high, "words": F.when(F.col("copies").isNull(), 0).otherwise((high - low) * F.col("copies"))})
    piece_of = F.when(F.col("copies").isNotNull(), F.struct(F.col("low").alias("start"), F.col("high").alias("stop"), F.col("copies").cast("long").alias("copies")))
    out = drawn.groupBy("s", "start", "row", "id", "th", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"), F.array_sort(F.collect_list(piece_of)).alias("drawn"))
    whole = (F.col("taken") == repeats * F.col("size")) | (F.col("taken") == 0)
    return out.select(F.col("id").alias(id_col), "th", "size", "source_size", "target", "taken", F.when(~whole, F.col("drawn")).alias("drawn"))


def mixed_texts(df: DataFrame, text_col: str, source_col: str, **options) -> DataFrame:
    """df's rows as the mix takes them: a text once for each pass it is drawn in, with its drawn words; whole texts stay as they are.

    Texts without words, null ones too, aren't drawn and go; repeated rows are drawn each; columns of any name pass through; an empty table gives an empty result.
    """
    columns = df.columns
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("held")), "mix-texts")
    own = rows.select("row", F.col("held")[text_col].alias("text"), F.col("held")[source_col].alias("source"))
    out = mix(own, "row", "text", "source", **options).where("taken > 0").select("row", "size", "taken", "drawn")
    whole = F.transform(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")), lambda _: F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))))
    pieces = F.transform(F.sequence(F.lit(1), F.array_max(F.col("drawn.copies")).cast("int")), lambda k: F.transform(F.filter("drawn", lambda p: p["copies"] >= k), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"))))
    passes = out.select("row", "size", F.explode(F.when(F.col("drawn").isNull(), whole).otherwise(pieces)).alias("ranges"))
    entire = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, p: n + p["stop"] - p["start"]) == F.col("size")
    joined = rows.join(passes, "row").withColumn("entire", entire)
    joined = joined.withColumn("words", F.when(~F.col("entire"), F.regexp_extract_all(F.col("held")[text_col], F.lit(f"({WORD_RX})"), F.lit(1))))
    taken = F.array_join(F.transform("ranges", lambda p: F.array_join(F.slice(F.col("words"), (p["start"] + 1).cast("int"), (p["stop"] - p["start"]).cast("int")), " ")), " ")
    text = F.when(F.col("entire"), F.col("held")[text_col]).otherwise(taken)
    return joined.select(*((text if c == text_col else F.col("held")[c]).alias(c) for c in columns))
