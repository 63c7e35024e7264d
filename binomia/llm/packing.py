"""Best-fit packing with bound-certified repacking.

Texts become token ids with an end id; longer ones are cut so that only their first piece may be short. Pieces
are dealt by hash over partitions of about `partition_items`; each partition packs its pieces by best-fit
decreasing and states a lower bound of its bin count from dual-feasible functions over its histogram of
lengths. A partition whose bin count equals its bound is certified: its bins are final but for the emptiest, which
has room for others' pieces. Partitions with gaps keep their full bins. The pieces of all other bins are exchanged,
dealt anew over fewer partitions, and packed again, until one partition is left or `rounds` are over.

Cases: a null or empty text is the end id alone; a text of any length is cut into whole pieces; repeated rows
are packed each; a null id is a value like any other; an empty table gives an empty result. Other columns are
left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import release, written
from binomia.llm.fastbpe import word_table

PARTITION_ITEMS = 100_000
CHARS = 1 << 19


def pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of each row's token ids."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in part.column(1).to_pylist()]
        ids, at = word_table(vocabulary).encode(texts)
        rows, piece, start, length, crc, own = [], [], [], [], [], []
        end = np.array([end_id], np.uint32)
        for r in range(len(texts)):
            doc = np.concatenate([ids[at[r] : at[r + 1]], end]).astype("<u4")
            head = (len(doc) - 1) % size + 1
            for k, a in enumerate([0, *range(head, len(doc), size)]):
                b = a + (head if k == 0 else size)
                rows.append(r)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(doc[a:b].tobytes()))
                if with_ids:
                    own.append(doc[a:b].astype(np.int32))
        columns = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * with_ids, names=names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size_of = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < b.num_rows:
                stop = int(np.searchsorted(size_of, (size_of[a - 1] if a else 0) + CHARS, side="right"))
                stop = min(b.num_rows, max(stop, a + 1))
                yield some(b.slice(a, stop - a))
                a = stop
            release()

    out = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return src.mapInArrow(run, out)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that lengths need at least; counts: of each length from 0 to size. The largest over two families of dual-feasible functions, the identity among them."""
    x = np.arange(size + 1, dtype=np.int64)
    c = counts.astype(np.int64)
    best = -(-int((x * c).sum()) // size)
    total, pieces_of = np.cumsum(x * c), np.cumsum(c)
    for least in range(1, size // 2 + 1):  # lengths over size - least fill a bin, lengths under least count nothing
        big = int(pieces_of[size] - pieces_of[size - least])
        mid = int(total[size - least] - total[least - 1])
        best = max(best, big + -(-mid // size))
    for k in range(1, 33):  # rounding to k-ths, exact multiples of a (k + 1)-th as they are
        y = (k + 1) * x
        f = np.where(y % size == 0, x * k, y // size * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((f * c).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length and the room left in each bin: longest first, into the fullest bin with room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # a bit for each room that some open bin has
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                mask ^= 1 << r
        else:
            b, r = len(room), size
            room.append(size)
        bins[i], offsets[i] = b, size - r
        room[b] = left = r - n
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(room, np.int64)


def _pack_round(items: DataFrame, parts: int, size: int, seed: int) -> DataFrame:
    """items with part, bin, offset, room (of the bin), loose (1 in the partition's emptiest bin), bins and bound (of the partition)."""
    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id", "piece", "ids_crc32", "salt"), F.lit(parts)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, size)
        bound = lower_bound(np.bincount(lengths, minlength=size + 1), size)
        n = len(lengths)
        loose = bins == np.argmax(room)  # the emptiest bin
        out = {"bin": bins, "offset": offsets, "room": room[bins], "loose": loose.astype(np.int64), "bins": np.full(n, len(room)), "bound": np.full(n, bound)}
        for k, v in out.items():
            table = table.append_column(k, pa.array(v, pa.int64()))
        return table

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", bin long, offset long, room long, loose long, bins long, bound long"
    return dealt.groupBy("part").applyInArrow(pack, schema)


def pack(items: DataFrame, size: int, partition_items: int = PARTITION_ITEMS, rounds: int = 4) -> tuple[DataFrame, list[tuple[int, int]]]:
    """items (id, piece, start, length, ids_crc32) with sequence_id and offset; and (bins, bound) totals of each round's partitions."""
    keep = ["id", "piece", "start", "length", "ids_crc32"]
    left = items.select(*keep, F.monotonically_increasing_id().alias("salt"))
    left = written(left, "pieces")
    done, report, n = [], [], left.count()
    parts = max(1, -(-n // partition_items))
    for k in range(rounds):
        now = written(_pack_round(left, parts, size, k), "packed")
        per = now.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        s = per.agg(F.sum("bins"), F.sum("bound")).first()
        report.append((s[0] or 0, s[1] or 0))
        last = parts == 1 or k == rounds - 1
        final = F.lit(True) if last else ((F.col("bins") == F.col("bound")) & (F.col("loose") == 0)) | (F.col("room") == 0)
        number = F.lit(k).cast("long") * (1 << 58) + F.col("part").cast("long") * (1 << 32) + F.col("bin")
        done.append(now.where(final).select(*keep, number.alias("sequence_id"), "offset"))
        if last:
            break
        left = now.where(~final).select(*keep, "salt")
        parts = max(1, min(parts // 2, -(-left.count() // partition_items)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, report


def pack_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): each row's pieces in sequences of at most `size` tokens."""
    out, _ = pack(pieces(df, id_col, text_col, vocabulary, size, end_id), size)
    return out.withColumnRenamed("id", id_col)
