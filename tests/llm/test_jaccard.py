"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from binomia.llm import jaccard
from binomia.llm.common import utf8



def _grams(text: str | None, n: int) -> frozenset:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[i : i + n]) for i in range(len(words) - n + 1)])


def _plain(rows: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    sets = [_grams(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def _texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "x\x85y", "Z"]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(5, 150))
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["new"], [w[k], "more"]])
            rows.append((len(rows) * 3 % 401, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w), "set", 1))
    chain = rng.choices(vocabulary, k=200)
    for step in range(12):  # each near the one before, the last far from the first
        rows.append((500 + step, " ".join(chain[step * 15 : step * 15 + 120] if step % 2 else chain[step * 15 : step * 15 + 124]), "n", 2))
    rows += [(600, None, None, None), (601, "", "x", 1), (602, " \t\n", "x", 1), (603, "a b c", "x", 1), (604, "A B\nc", "x", 1), (605, "a b", "x", 1), (606, "a " * 2000, "x", 1), (607, "a a a a a", "x", 1), (608, "one two three four five six " * 60_000, "x", 1)]
    return rows + rows[:3] + [(None, rows[0][1], "x", 1), (None, "", "x", 1), (None, "only here and nowhere else at all", "x", 1)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 5, 80), (2, 5, 80), (3, 2, 60), (4, 1, 95)])
def test_components_against_all_pairs(spark, seed, n, percent):
    rows = _texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, set string, n int").repartition(5)
    got = [tuple(r) for r in jaccard.jaccard_components(df, "doc_id", "text", n, percent).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(_plain(rows, n, percent), key=key)


def test_fragments_and_hot_ngrams_change_nothing(spark, monkeypatch):
    rows = _texts(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, set string, n int").repartition(3)
    whole = sorted(map(str, jaccard.jaccard_components(df, "doc_id", "text").collect()))
    monkeypatch.setattr(jaccard, "FRAGMENT", 500)
    monkeypatch.setattr(jaccard, "HOT_IN_SAMPLE", 5)
    assert sorted(map(str, jaccard.jaccard_components(df, "doc_id", "text").collect())) == whole


def test_links_missed_by_representatives_are_found(spark):
    """No MinHash value at all: every link comes from the prefix join."""
    rows = [r for r in _texts(6) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string, set string, n int")
    texts = df.selectExpr("doc_id AS id", "text AS t")
    none = np.zeros(0, np.uint64)
    able = jaccard._able(jaccard._shared(jaccard._segments(texts.select("t"), 5, 3, none), 4, none, none.astype(np.int64)), 4, 80).cache()
    ids = {r.id: r.set for r in jaccard._sets(texts, 5, 1).collect()}
    sets = {ids[r[0]]: _grams(r[1], 5) for r in rows if _grams(r[1], 5)}
    expected = {frozenset((a, b)) for a in sets for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    alone = spark.createDataFrame([], "node long, root long")
    pairs = jaccard.prefix_pairs(able, alone, 80)
    assert {frozenset((r.a, r.b)) for r in jaccard.verified(pairs, able, 80).collect()} == expected
    assert pairs.count() <= 4 * len(expected)


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    one = jaccard.jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert [tuple(r) for r in one] == [(1, 0, 1)]


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    sets = np.repeat(rng.integers(-(1 << 60), 1 << 60, 50), 20)
    h, more = rng.integers(0, 1 << 48, 1000).astype(np.uint64), rng.integers(0, 1 << 30, 1000)
    batch = jaccard._packed(rng.integers(-3, 5, 1000), sets, np.full(1000, 7), h, more)
    got = jaccard._unpacked(pa.Table.from_batches([batch]))
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(zip(sets.tolist(), [7] * 1000, h.tolist(), more.tolist(), strict=True))


def test_sets_of_a_slice():
    texts = ["a b c d e f", None, "a b c d e f a b c d e f", "x", "", "x y z"]
    hashes, sizes = jaccard.ngram_sets(*utf8(pa.array(texts)), 5)
    assert sizes.tolist() == [len(_grams(t, 5)) for t in texts]
    assert len(set(jaccard.set_ids(hashes, sizes).tolist())) == 5


def test_many_near_sets_make_few_pairs(spark):
    """A common passage, and variants of one text: the prefix join is left with next to nothing."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2])):
            w[rng.randrange(len(w))] = f"own{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[:80] + passage + w[80:])))
    rows += [(1000 + i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(60)] + passage)) for i in range(300)]
    texts = spark.createDataFrame(rows, "id long, t string")
    none = np.zeros(0, np.uint64)
    able = jaccard._able(jaccard._shared(jaccard._segments(texts.select("t"), 5, 1, none), 1, none, none.astype(np.int64)), 1, 80).cache()
    near = jaccard.contracted(able, 80)
    assert near.count() >= 290
    assert jaccard.prefix_pairs(able, near, 80).count() <= 3000  # of 45,000
    got = {r.id: r.component_id for r in jaccard.jaccard_components(texts, "id", "t").collect()}
    assert got == {i: c for i, _, c in _plain(rows)}
