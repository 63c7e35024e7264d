"""Spelling variant grouping: words of a corpus, pairs of them one edit apart, and the frequent form each rare one leads to.

Words are counted in Arrow batches (runs of letters are found by array operations, one distinct word a row goes on) and summed by
Spark. Pairs come from an even-partition pigeonhole join, all in DataFrame functions. A word is cut into two segments whose lengths
depend on its length alone: of two words one edit apart, one segment is whole in both, at its place or shifted by the edit. The
segment with the edit is cut in two once more by the same argument, so that a key is a word without one of its four parts: its
beginning and its end. A word's parts are indexed by its own length; it probes by that length and, cut as a word one shorter with one
more code point left out, by the length below. Equal keys are candidates; the join's condition takes a pair under its first key only and
verifies the edit, so no candidate is shuffled. Forms are followed to their last by pointer doubling on written tables.

Cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count each; ties in n go to the word that is
smallest in code-point order; a word without near words has n_near 0 and is its own root; very long texts are read whole, a run of letters of any
length too; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import drop_written, release, spans, utf8, written

SLICE = 4 << 20  # bytes of text worked on at a time
LONG = 96  # bytes from which a run's checksum is taken alone

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LEAD = 0xC3  # the lead byte of U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def letter_runs(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind the last, code points) of each maximal run of letters; a run ends with its text."""
    lead = body == _LEAD
    letter = _ASCII[body] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    opens, closes = letter.copy(), letter.copy()
    opens[1:] &= ~letter[:-1] | edge[1:-1]
    closes[:-1] &= ~letter[1:] | edge[1:-1]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    twos = np.concatenate([[0], np.cumsum(lead)])
    return start, stop, stop - start - (twos[stop] - twos[start])


def checksums(low: np.ndarray, start: np.ndarray, stop: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes behind a text of checksum `begun`, all runs a byte at a time."""
    size = stop - start
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    many = int(np.searchsorted(-size[order], -LONG))
    for i in order[:many]:
        out[i] = zlib.crc32(low[start[i] : stop[i]].tobytes(), int(begun[i]))
    order = order[many:]
    at, left, crc = start[order], size[order], ~begun[order]
    n, j = int(np.searchsorted(-left, 0)), 0
    while n:
        crc[:n] = _CRC[(crc[:n] ^ low[at[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
        j += 1
        n = int(np.searchsorted(-left, -j))
    out[order] = ~crc
    return out


def _without(word: str, h: int) -> str:
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def _counts(ids: list, texts: pa.Array, modulus: int, least: int) -> pa.RecordBatch | None:
    body, offsets = utf8(texts)
    if not len(body):
        return None
    low = _LOWER[body]
    start, stop, points = letter_runs(body, offsets)
    keep = points >= least
    start, stop, points = start[keep], stop[keep], points[keep]
    of = np.searchsorted(offsets, start, side="right") - 1
    prefix = np.fromiter((zlib.crc32(b"%s:" % ("" if i is None else str(i)).encode()) for i in ids), np.uint32, len(ids))
    h = checksums(low, start, stop, prefix[of])
    hit = h % np.uint32(modulus) == 0
    changed = [_without(low[a:z].tobytes().decode(), x) for a, z, x in zip(start[hit].tolist(), stop[hit].tolist(), h[hit].tolist(), strict=True)]
    changed = [w for w in changed if len(w) >= least]
    start, size = start[~hit], (stop - start)[~hit]
    ends = np.concatenate([[0], np.cumsum(size)])
    data = low[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    found = pc.value_counts(pa.concat_arrays([words, pa.array(changed, pa.large_string())]))
    return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])


def word_counts(df: DataFrame, id_col: str, text_col: str, modulus: int = 31, least: int = 7) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least `least` code points, counted by slices of texts, not yet summed.

    A run whose crc32 with its document's id is divisible by `modulus` loses the code point that this checksum names.
    """
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))])
            for a, z in spans(offsets, SLICE):
                out = _counts(b.column(0).slice(a, z - a).to_pylist(), b.column(1).slice(a, z - a), modulus, least)
                if out is not None:
                    yield out
        release()

    return src.mapInArrow(run, "word string, n long")


def vocabulary(df: DataFrame, id_col: str, text_col: str, modulus: int = 31, least: int = 7, often: int = 2) -> DataFrame:
    """(word, n) of every word found at least `often` times."""
    return word_counts(df, id_col, text_col, modulus, least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _parts(size: Column) -> list[tuple[Column, Column]]:
    """(code points from the beginning, code points from the end) of each key of a word of this length: all but one of its four parts."""
    half = F.floor(size / 2)
    first, third = F.floor(half / 2), F.floor((size - half) / 2)
    nothing = F.lit(0)
    return [(half + third, nothing), (half, size - half - third), (first, size - half), (nothing, size - first)]


def _key(word: Column, size: Column, part: int) -> Column:
    left, right = _parts(size)[part]
    return F.xxhash64(size, F.lit(part), F.left(word, left), F.right(word, right))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of different words of (word, n) that one inserted, deleted or replaced code point apart are, once; a is the shorter or smaller one."""
    size = F.char_length("word").cast("long")

    def keyed(of: Column) -> list[Column]:
        return [F.struct(F.lit(k).alias("part"), _key(F.col("word"), of, k).alias("key")) for k in range(4)]

    own, longer = F.array(*keyed(size)), F.array(*keyed(size - 1))
    index = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(own).alias("k")).select("a", "a_n", F.col("k.part").alias("a_part"), "k.key")
    probe = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.concat(own, longer)).alias("k")).select("b", "b_n", F.col("k.part").alias("b_part"), F.col("k.key").alias("b_key"))
    a, b, a_size = F.col("a"), F.col("b"), F.char_length("a").cast("long")
    same = [(F.left(a, left) == F.left(b, left)) & (F.right(a, right) == F.right(b, right)) for left, right in _parts(a_size)]
    first = F.when(same[0], 0).when(same[1], 1).when(same[2], 2).when(same[3], 3)
    grows = F.char_length("b").cast("long") - a_size
    near = (F.col("key") == F.col("b_key")) & (F.col("a_part") == F.col("b_part")) & ((grows == 1) | (grows == 0) & (a < b)) & (F.levenshtein(a, b, 1) == 1) & (F.col("a_part") == first)
    return index.hint("merge").join(probe, near).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each word's forms followed to the last. A form is ten times as frequent, so chains are short and have no circle."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        drop_written(now)
        now = new
        if not moved:
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n): form is the near word of largest n if that is at least `ratio` times the word's."""
    words = written(words, "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("n")))).alias("p"))
    best = both.groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.n")).alias("less"), F.col("p.other").alias("form"))).alias("best"))
    held = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    held = written(
        held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")),
        "near",
    )
    roots = _roots(held.where("form IS NOT NULL"))
    return held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(df: DataFrame, id_col: str, text_col: str, modulus: int = 31, least: int = 7, often: int = 2, ratio: int = 10) -> DataFrame:
    """variants() of a corpus's vocabulary()."""
    return variants(vocabulary(df, id_col, text_col, modulus, least, often), ratio)
