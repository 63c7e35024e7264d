"""N-gram Jaccard join: vertical partitioning of the global n-gram order.

A text's set of n-grams is an array of hashes. The order of all hashes is cut into fragments of equal ranges; a text sends each fragment its
segment, packed with other texts' by Arrow batch. A fragment counts alone which of its n-grams are in two sets or more; what only one set holds can't add to
an overlap and goes no further. The partial counts sum up to a set's shared n-grams: only sets that share as large a part as a link asks for stay. Candidates agree
in one of the rarest n-grams of both (the prefix filter: rarer first, then by hash, an order that all sets have in common); of each candidate pair
the segments meet by fragment, partial overlaps are counted separately and summed per pair, and the sum decides.

Many sets near each other would give all their pairs. So each set first meets only the representatives of the groups that pairs of its MinHash values put it in; these
links, verified like the others, are contracted to components, a few times with other representatives. The prefix join then pairs sets of different components only, and an n-gram whose sets are
all in one component gives no pair. Of both kinds of pairs a bitmap of each set bounds the overlap from above before segments move. No link between components is lost.

N-grams that a bounded sample of sets shows in many of them (a passage in a third of all texts) would all meet in one fragment; they
are known to be shared, stand last in the order and are dealt over fragments of their own by set. Hashes have 64 bits, 48 of them within fragments.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; with fewer words than n the whole sequence is the one n-gram; equal
sets are one node; repeated rows are rows of the same set; a null id joins its component but is never its smallest id; very long texts are read whole; an empty
table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import drop_written, release, spans, table_path, utf8, written
from binomia.llm.simhash import components
from binomia.llm.words import mixed, word_keys

SLICE = 1 << 18  # bytes of text worked on at a time
FRAGMENT = 1 << 19  # n-grams in a fragment, about
PACK = 1 << 17  # n-grams gathered before they are packed by fragments
SAMPLE, HOT_IN_SAMPLE, HOT_LIST = 1 << 12, 16, 1 << 17  # sets looked at for hot n-grams, sets that make one hot, n-grams listed at most
HOT = 1 << 30  # places hot n-grams behind all others
PARTS = 16  # fragments in which a pair's overlap is counted
MINS, TURNS, SALT = 16, (1, 6), 16  # MinHash values, two of which make a group; a group's representatives by turn; parts that its rows are dealt over
BITS = 2048  # of a set's bitmap
_MUL, _SET = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1 << 63, size=MINS, dtype=np.uint64)


def ngram_sets(body: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each text's set): the texts' distinct n-grams, each text's in order."""
    keys, before = word_keys(body, offsets)
    count = np.diff(before)
    rolled = np.zeros(len(keys), np.uint64)
    whole = max(0, len(keys) - n + 1)
    for j in range(n):
        rolled[:whole] = rolled[:whole] * _MUL + keys[j : j + whole]
    rolled = mixed(rolled)
    own = np.maximum(count - n + 1, np.minimum(count, 1))  # n-grams with repeats
    starts = np.concatenate([[0], np.cumsum(own)])
    out = np.empty(starts[-1], np.uint64)
    for t, (a, c, s) in enumerate(zip(before[:-1].tolist(), count.tolist(), starts.tolist(), strict=False)):
        if c >= n:
            out[s : s + own[t]] = np.sort(rolled[a : a + own[t]])
        elif c:
            h = np.array([c], np.uint64)
            for j in range(c):
                h = h * _MUL + keys[a + j]
            out[s] = mixed(h ^ _SET)[0]
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[:-1][own > 0]] = True
    held = np.concatenate([[0], np.cumsum(new)])
    return out[new], np.diff(held[starts])


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; of an empty one 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ _SET))])
    ends = np.cumsum(sizes)
    ids = mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))
    ids[sizes == 0] = 0
    return ids.view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: int, n: int) -> Iterator[tuple]:
    """(batch slice, hashes, sizes, ids) of some megabytes of text at a time."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, z in spans(np.concatenate([[0], np.cumsum(length)]), SLICE):
            part = b.slice(a, z - a)
            hashes, sizes = ngram_sets(*utf8(part.column(column)), n)
            yield part, hashes, sizes, set_ids(hashes, sizes)


def _sets(df: DataFrame, n: int, every: int) -> DataFrame:
    """(id, n, set, sample) of (id, t): sample has the hashes of the sets whose id is divisible by `every`, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, hashes, sizes, ids in _slices(batches, 1, n):
            ends = np.cumsum(sizes)
            sample = []
            for i, (e, s, size) in enumerate(zip(ends.tolist(), ids.tolist(), sizes.tolist(), strict=True)):
                take = size > 0 and s % every == 0 and s not in seen
                if take:
                    seen.add(s)
                sample.append(hashes[e - sizes[i] : e].tobytes() if take else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids), pa.array(sample, pa.binary())], names=["id", "n", "set", "sample"])
        release()

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n long, set long, sample binary")


def hot_ngrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes, how many sets of the sample hold each) of n-grams in many of the sampled sets; at most HOT_LIST of them, by the sample's size."""
    sample = docs.where("sample IS NOT NULL").dropDuplicates(["set"]).select("sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = b.column(0).slice(k, 256).to_pylist()
                h, c = np.unique(np.frombuffer(b"".join(rows), np.uint64) >> np.uint64(16), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    least = docs.where("sample IS NOT NULL").agg(F.sum("n")).first()[0] or 0
    found = sample.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(HOT_IN_SAMPLE, -(-least // HOT_LIST))).toPandas().sort_values("h")
    return found["h"].to_numpy(np.uint64), found["c"].to_numpy(np.int64)


def _packed(place: np.ndarray, sets: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a place: its sets with their sizes and numbers of hashes, and the hashes by six bytes each. Input is in order of set."""
    order = np.argsort(place, kind="stable")
    place, sets, sizes, hashes = place[order], sets[order], sizes[order], hashes[order]
    more = None if more is None else more[order].astype(np.int32)
    head = np.ones(len(place), bool)
    head[1:] = (place[1:] != place[:-1]) | (sets[1:] != sets[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(place))).astype(np.int32)
    cut = np.flatnonzero(np.diff(place, prepend=place[:1] - 1)) if len(place) else np.zeros(0, np.int64)
    ends, group = np.append(cut, len(place)), np.append(np.searchsorted(first, cut), len(first))
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint16)
    ids, n = sets[first], sizes[first].astype(np.int32)
    rows = []
    for i, c in enumerate(cut):
        a, z, f, g = c, ends[i + 1], group[i], group[i + 1]
        rows.append((int(place[c]), ids[f:g].tobytes(), n[f:g].tobytes(), count[f:g].tobytes(), low[a:z].tobytes(), high[a:z].tobytes(), b"" if more is None else more[a:z].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=_NAMES)


_NAMES = ["place", "sets", "sizes", "counts", "low", "high", "more"]
_PACKED = "place long, sets binary, sizes binary, counts binary, low binary, high binary, more binary"


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(set, size, hash, more) of every hash of packed rows."""
    joined = [np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in zip(_NAMES[1:], (np.int64, np.int32, np.int32, np.uint32, np.uint16, np.int32), strict=True)]
    sets, sizes, counts, low, high, more = joined
    return np.repeat(sets, counts), np.repeat(sizes, counts), low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), more


def _segments(df: DataFrame, n: int, fragments: int, hot: np.ndarray) -> DataFrame:
    """Packed segments of the sets of (t), each set once a task; place: the fragment, or below zero one of those that hot n-grams are dealt over by set."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        h, sets, size = (np.concatenate(x) for x in zip(*held, strict=True))
        place = ((h >> np.uint64(16)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            place = np.where(hot[at] == h, -1 - (mixed(sets.view(np.uint64)) % np.uint64(fragments)).astype(np.int64), place)
        return _packed(place, sets, size, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, total = [], 0
        for _, hashes, sizes, ids in _slices(batches, 0, n):
            new = []
            for s, size in zip(ids.tolist(), sizes.tolist(), strict=True):
                new.append(size > 0 and s not in seen)
                seen.add(s)
            keep = np.array(new, bool)
            own = np.repeat(keep, sizes)
            held.append((hashes[own] >> np.uint64(16), np.repeat(ids[keep], sizes[keep]), np.repeat(sizes[keep].astype(np.int32), sizes[keep])))
            total += len(held[-1][0])
            if total >= PACK:
                yield packed(held)
                held, total = [], 0
        if total:
            yield packed(held)
        release()

    return df.mapInArrow(run, _PACKED)


def _shared(segments: DataFrame, ranges: int, hot: np.ndarray, hot_counts: np.ndarray) -> DataFrame:
    """Packed n-grams found in two sets or more, with the number of sets, by ranges of set ids. A fragment is a group."""

    def run(table: pa.Table) -> pa.Table:
        is_hot = table.column(0)[0].as_py() < 0
        sets, sizes, h, _ = _unpacked(table)
        order = np.lexsort((sets, h))
        sets, sizes, h = sets[order], sizes[order], h[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (sets[1:] != sets[:-1])  # tasks know only their own sets
        sets, sizes, h = sets[once], sizes[once], h[once]
        if is_hot:
            held = HOT + hot_counts[np.searchsorted(hot, h)]
        else:
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(head, len(h)))
            held = np.repeat(count, count)
            sets, sizes, h, held = (x[held > 1] for x in (sets, sizes, h, held))
        order = np.argsort(sets, kind="stable")
        sets, sizes, h, held = sets[order], sizes[order], h[order], held[order]
        place = ((sets.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        out = pa.Table.from_batches([_packed(place, sets, sizes, h, held)])
        release()
        return out

    return segments.repartition(ranges, "place").groupBy("place").applyInArrow(run, _PACKED)  # as many tasks as fragments, whatever a session's setting is


def _able(shared: DataFrame, ranges: int, percent: int) -> DataFrame:
    """Of the sets that share enough n-grams to link at all: (set, n, part, hashes, shared, lead, places, mins, bits), a row a part of the order; the last four are in a set's first row.

    lead: the shared ones among its rarest n-grams, one of which a linked set must have too, with their places among all of the set's.
    """

    def run(table: pa.Table) -> pa.Table:
        sets, sizes, h, held = _unpacked(table)
        order = np.lexsort((h, held, sets))
        sets, sizes, h = sets[order], sizes[order].astype(np.int64), h[order]
        first = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]])) if len(sets) else np.zeros(0, np.int64)
        shared_n = np.diff(np.append(first, len(sets)))
        n = sizes[first]
        least = -(-percent * n // 100)
        rows: list[list] = [[] for _ in range(9)]
        for i in np.flatnonzero(shared_n >= np.maximum(least, 1)).tolist():
            own = h[first[i] : first[i] + shared_n[i]]
            alone = int(n[i] - shared_n[i])  # the rarest of all: no other set has them
            lead = own[: int(n[i] - least[i]) + 1 - alone].view(np.int64)
            mins = [int(mixed(own ^ s).min().view(np.int64)) for s in _SEEDS]
            places = np.arange(alone, alone + len(lead), dtype=np.int32)
            bits = np.zeros(BITS // 64, np.uint64)
            at = mixed(own ^ _MUL) % np.uint64(BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            own = np.sort(own)
            part = (own >> np.uint64(44)).astype(np.int64)
            for k, p in enumerate(np.unique(part).tolist()):
                for to, x in zip(rows, (int(sets[first[i]]), int(n[i]), p, own[part == p].view(np.int64), len(own), *((lead, places, mins, bits.view(np.int64)) if k == 0 else ((), (), (), ()))), strict=True):
                    to.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["set", "n", "part", "hashes", "shared", "lead", "places", "mins", "bits"])

    return shared.repartition(ranges, "place").groupBy("place").applyInArrow(run, "set long, n long, part int, hashes array<long>, shared long, lead array<long>, places array<int>, mins array<long>, bits array<long>")


def _bucketed(able: DataFrame) -> DataFrame:
    """able, written in buckets by set and part: what is joined to it by these shuffles its own side alone."""
    spark = able.sparkSession
    name, buckets = f"binomia_able_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = table_path(spark, "able")
    able.repartition(buckets, "set", "part").write.bucketBy(buckets, "set", "part").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.binomia_table, out.binomia_path = name, path
    return out


def _drop_bucketed(able: DataFrame) -> None:
    able.sparkSession.sql(f"DROP TABLE {able.binomia_table}")
    drop_written(able)


def verified(pairs: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, a_n, b, b_n) that link: partial overlaps counted by part of the order, summed per pair."""
    split = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    one = able.select(F.col("set").alias("a"), "part", F.col("hashes").alias("a_hashes"))
    two = able.select(F.col("set").alias("b"), "part", F.col("hashes").alias("b_hashes"))
    partial = split.join(one, ["a", "part"]).join(two, ["b", "part"]).select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_hashes", "b_hashes")).alias("overlap"))
    total = partial.groupBy("a", "b", "a_n", "b_n").agg(F.sum("overlap").alias("overlap"))
    return total.where((100 + percent) * F.col("overlap") >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def _sizes_fit(percent: int):
    return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (set, ...) with the root of each set's component."""
    return rows.join(found, rows["set"] == found["node"], "left").withColumn("root", F.coalesce("root", "set")).drop("node")


def possible(pairs: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, a_n, b, b_n) that a bound on their overlap lets pass, which no link fails: a bit that differs needs an n-gram of one set alone."""
    marks = able.where(F.size("mins") > 0)
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("set").alias(side), F.col("shared").alias(f"{side}_shared"), F.col("bits").alias(f"{side}_bits")), side)
    apart = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    twice = F.col("a_shared") + F.col("b_shared") - apart
    return pairs.where((100 + percent) * twice >= 2 * percent * (F.col("a_n") + F.col("b_n"))).select("a", "a_n", "b", "b_n")


def representative_pairs(bands: DataFrame, found: DataFrame, percent: int, seeds: range) -> DataFrame:
    """(a, a_n, b, b_n): each set of (k, key, set, n) with its groups' representatives, one by each seed, where these are of another component.

    These pairs only save others: a link that isn't among them comes from prefix_pairs(). A group may be of any size: its rows are salted, and a group of one component makes none.
    """
    rows = _rooted(bands, found).withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALT)).cast("int"))
    chosen = rows.groupBy("k", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array_distinct(F.array(*(F.min_by(F.struct("set", "n", "root"), F.xxhash64("set", "k", F.lit(i))) for i in seeds))).alias("r")).where("low <> high")
    chosen = chosen.select("k", "key", F.explode("r").alias("r")).select("k", "key", "r", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    pairs = rows.join(chosen, ["k", "key", "salt"]).where("root <> r.root")
    one, two = F.struct("set", "n"), F.struct(F.col("r.set").alias("set"), F.col("r.n").alias("n"))
    pairs = pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    return pairs.select(F.col("a.set").alias("a"), F.col("a.n").alias("a_n"), F.col("b.set").alias("b"), F.col("b.n").alias("b_n")).where(_sizes_fit(percent))


def contracted(able: DataFrame, percent: int) -> DataFrame:
    """(node, root): components of the links found with representatives, in a few turns."""
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.xxhash64(F.get("mins", F.lit(2 * k)), F.get("mins", F.lit(2 * k + 1))).alias("key")) for k in range(MINS // 2)))
    bands = written(able.where(F.size("mins") > 0).select("set", "n", F.explode(keys).alias("b")).select("b.k", "b.key", "set", "n"), "bands")
    found = able.sparkSession.createDataFrame([], "node long, root long")
    for turn, several in enumerate(TURNS):
        begun = sum(TURNS[:turn])
        new = written(verified(possible(representative_pairs(bands, found, percent, range(begun, begun + several)), able, percent), able, percent), "close")
        if new.isEmpty():
            break
        found = components(_edges(found).unionByName(new))
        drop_written(new)
    drop_written(bands)
    return found


def prefix_pairs(able: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, a_n, b, b_n), each once: sets of different components (node, root) that agree in one of both's rarest n-grams and may still reach the overlap behind it."""
    leads = able.where(F.size("lead") > 0).select("set", "n", F.explode(F.arrays_zip("lead", "places")).alias("l"))
    leads = leads.select("set", "n", F.col("l.lead").alias("h"), F.col("l.places").alias("place"))
    leads = written(_rooted(leads, found).select("h", "place", "set", "n", "root"), "leads")
    open_ = leads.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    leads = leads.join(open_, "h", "left_semi")
    a = leads.select("h", *(F.col(c).alias(f"a_{c}") for c in ("place", "set", "n", "root")))
    b = leads.select(F.col("h").alias("b_h"), *(F.col(c).alias(f"b_{c}") for c in ("place", "set", "n", "root")))
    reach = 1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) - 1
    may = (F.col("h") == F.col("b_h")) & (F.col("a_set") < F.col("b_set")) & (F.col("a_root") != F.col("b_root")) & _sizes_fit(percent) & ((100 + percent) * reach >= percent * (F.col("a_n") + F.col("b_n")))
    return a.join(b, may).select(F.col("a_set").alias("a"), "a_n", F.col("b_set").alias("b"), "b_n").distinct()


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("a"), F.col("root").alias("b"))


def linked(able: DataFrame, percent: int) -> DataFrame:
    """(node, root): components of all links."""
    found = contracted(able, percent)
    other = written(verified(possible(prefix_pairs(able, found, percent), able, percent), able, percent), "links")
    return components(_edges(found).unionByName(other))


def jaccard_components(df: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): texts link when their sets' Jaccard similarity is `percent` or more; component_id is the smallest id reachable."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    docs = written(_sets(texts, n, max(1, df.count() // SAMPLE)), "sets")
    total = docs.agg(F.sum("n")).first()[0] or 0
    hot, counts = hot_ngrams(docs)
    fragments = max(1, -(-total // FRAGMENT))
    able = _bucketed(_able(_shared(_segments(texts.select("t"), n, fragments, hot), fragments, hot, counts), fragments, percent))
    found = linked(able, percent)
    least = docs.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
    rooted = _rooted(least, found)
    label = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set", "component_id")
    _drop_bucketed(able)
    joined = docs.select("id", "n", F.when(F.col("n") > 0, F.col("set")).alias("set")).join(label, "set", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
