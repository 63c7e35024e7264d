"""SimHash near-dedup: deletion-variant signatures, an equality join, verification, components.

With at most k differing bits, cutting the 64 bits into k // 2 + 1 segments leaves one that differs by at
most one bit. Each distinct fingerprint is indexed under every segment with one bit wiped out, an equality
join brings pairs together, and the join's own condition verifies the distance, keeping a pair only under the
one variant that is first for it, so that each link comes out once. Rows of equal fingerprint are one node.
Such a variant has some 20 bits, so candidates grow with the square of the fingerprints; beyond DEEP of them the other bits are
cut too, into so many pieces that one must be equal, and a variant is indexed with each: some 30 bits, for the same links.
Components come from alternating star contractions on written tables.

Cases: a null or empty text has fingerprint 0 and links like any other; with fewer words than a shingle the
whole sequence is one shingle; repeated rows share a fingerprint; a null id joins its component but is never
its smallest id; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import drop_written, written

SEED = 42
DEEP = 1 << 22  # fingerprints from which the longer keys of more variants cost less; the links are the same
BLOCK = 1 << 18  # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text's word shingles, unsigned: a bit is 1 if set in over half the hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(start, stop[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp): fp is the unsigned fingerprint's bits as a long."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                fp = np.fromiter((fingerprint(t, shingle) for t in part.column(1).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def segments(k: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = k // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(low: int, width: int) -> int:
    return ((1 << width) - 1) << low


def _first_variant(x: Column, k: int) -> Column:
    """Of a pair with xor x, the lowest wiped-out bit under which both have the same variant, in the first segment that differs by at most one bit."""
    out = F.lit(-1)
    for low, width in reversed(segments(k)):
        own = x.bitwiseAND(F.lit(_signed(_mask(low, width))))
        lowest = F.bit_count(own - 1)  # zeros below the lowest set bit
        out = F.when(own == 0, F.lit(low)).when(F.bit_count(own) == 1, lowest).otherwise(out)
    return out


def links(distinct: DataFrame, k: int = 4) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints (column fp) that differ in at most k bits, once."""
    variants = []
    for low, width in segments(k):
        for bit in range(low, low + width):
            variants.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(low, width) & ~(1 << bit)))).alias("value")))
    index = distinct.select("fp", F.explode(F.array(*variants)).alias("v")).select("fp", "v.bit", "v.value")
    a, b = index.select(F.col("fp").alias("a"), "bit", "value"), index.select(F.col("fp").alias("b"), F.col("bit").alias("bit2"), F.col("value").alias("value2"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.bit_count(x) <= k) & (F.col("a") < F.col("b")) & (F.col("bit").cast("int") == _first_variant(x, k))
    # the index is 64 times its input, which a size estimate from that misses: never broadcast it
    return a.hint("merge").join(b, (F.col("bit") == F.col("bit2")) & (F.col("value") == F.col("value2")) & near).select("a", "b")


def _pieces(low: int, width: int, n: int) -> list[int]:
    """Masks that cut the bits outside a segment into n pieces."""
    rest = [b for b in range(64) if not low <= b < low + width]
    edges = [round(len(rest) * i / n) for i in range(n + 1)]
    return [sum(1 << b for b in rest[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def deep_links(distinct: DataFrame, k: int = 4) -> DataFrame:
    """As links(), by longer keys: a segment that is equal and one of k + 1 pieces of the rest, or one with a bit wiped out and one of k."""
    masks: list[int] = []  # of each key, by its number
    first = F.lit(-1)  # of a pair with xor x, the number of its first key
    x = F.col("a").bitwiseXOR(F.col("b"))

    def piece(own: list[int], number) -> Column:
        out = F.lit(-1)
        for i, m in reversed(list(enumerate(own))):
            out = F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, number + i).otherwise(out)
        return out

    places = []
    for low, width in segments(k):
        whole, equal, other = _mask(low, width), _pieces(low, width, k + 1), _pieces(low, width, k) if k else []
        start = len(masks)
        masks += [whole | m for m in equal]
        wiped = len(masks)
        masks += [whole & ~(1 << bit) | m for bit in range(low, low + width) for m in other]
        places.append((low, whole, equal, other, start, wiped))
    for low, whole, equal, other, start, wiped in reversed(places):
        own = x.bitwiseAND(F.lit(_signed(whole)))
        bit = F.bit_count(own - 1)  # zeros below the lowest set bit
        first = F.when(own == 0, piece(equal, F.lit(start))).when(F.bit_count(own) == 1, piece(other, F.lit(wiped) + (bit - low) * len(other))).otherwise(first)
    keys = [F.struct(F.lit(i).cast("short").alias("key"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("v")).select("fp", "v.key", "v.value")
    a, b = index.select(F.col("fp").alias("a"), "key", "value"), index.select(F.col("fp").alias("b"), F.col("key").alias("key2"), F.col("value").alias("value2"))
    near = (F.bit_count(x) <= k) & (F.col("a") < F.col("b")) & (F.col("key").cast("int") == first)
    return a.hint("merge").join(b, (F.col("key") == F.col("key2")) & (F.col("value") == F.col("value2")) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star contractions in turn until the edges stay as they are; each round is written to the shared folder.
    """
    now = written(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    seen = None
    while True:
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        large = written(large, "large")
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("m").alias("root")), F.struct("node", F.col("m").alias("root")))).alias("e")).select("e.node", "e.root")
        new = written(small.where("node <> root").distinct(), "small")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        drop_written(now)
        drop_written(large)
        now = new
        if state == seen:
            return now
        seen = state


def near_duplicates(df: DataFrame, id_col: str, text_col: str, shingle: int = 4, k: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): fingerprints at most k bits apart link; component_id is the smallest id reachable."""
    fps = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fp")
    distinct = least.select("fp")
    found = components(deep_links(distinct, k) if distinct.count() > DEEP else links(distinct, k))
    rooted = least.join(found, least["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(of, "root").select("fp", "component_id")
    return fps.join(label, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
