"""Line dedup, SimHash, sharding and mixing against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from binomia.llm import linededup, mixing, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STRIP = " \t\n\x0b\x0c\r"


def _key(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def _texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    common = [f"Common Line {i}" for i in range(5)]
    out = []
    for i in range(n):
        lines = [rng.choice([*common, "", " É x ", f"own {rng.randint(0, 60)}", "COMMON line 1\t"]) for _ in range(rng.randint(1, 6))]
        out.append((i, rng.choice([None, ""]) if i % 17 == 0 else "\n".join(lines), "en", rng.choice(["b", "a", None, "a", "a"]), 0))
    return out + out[3:6]


def test_line_dedup(spark):
    rows = _texts(1, 90)
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", lines int")
    held = Counter(k for r in rows for k in {_key(x) for x in (r[1] or "").split("\n")})
    gone = {k for k, n in held.items() if n >= 10 and k}
    assert len(gone) >= 5
    expected = Counter((r[0], len((r[1] or "").split("\n")), sum(_key(x) in gone for x in (r[1] or "").split("\n")), "\n".join(x for x in (r[1] or "").split("\n") if _key(x) not in gone)) for r in rows)
    got = linededup.drop_frequent_lines(df, "doc_id", "text", 10).collect()
    assert Counter(map(tuple, got)) == expected
    assert linededup.drop_frequent_lines(df.limit(0), "doc_id", "text").count() == 0


def test_line_dedup_keeps_the_first(spark):
    rows = [(i, "same line\nown %d" % i, "en", "s", 0) for i in range(12)] + [(100 + i, "copy a\ncopy b", "en", "s", 0) for i in range(15)]
    out = {r.doc_id: r.kept for r in linededup.drop_frequent_lines(spark.createDataFrame(rows, DOCS), "doc_id", "text", by_text=True, keep_first=True, carry=("lang",)).collect()}
    assert out[0] == "same line\nown 0"
    assert out[5] == "own 5"
    assert all(out[100 + i] == "copy a\ncopy b" for i in range(15))  # one text, however often


def test_runs_are_compacted(spark):
    runs = linededup.LineRuns(spark, threshold=3, fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b * 10 + i, k, k) for i, k in enumerate([1, 1, 2 + b, 9])] + [(b * 10, 9, 9)], "row long, h1 long, h2 long"))
    assert sum(map(len, runs.levels)) < 5
    assert sorted((r.h1, r.h2) for r in runs.frequent().collect()) == [(1, 1), (9, 9)]
    runs.close()


def test_every_batch_but_the_first_meets_settled_lines(spark, monkeypatch):
    """Of one partition too: batches are by hash, and each later one leaves out lines that the runs before it have settled."""
    seen = []
    whole = linededup.LineRuns.uncounted

    def counted(self, own):
        own = own.cache()
        left = whole(self, own)
        seen.append((own.count(), own.count() - left.count()))
        return left

    monkeypatch.setattr(linededup.LineRuns, "uncounted", counted)
    rows = [(i, f"everywhere\nhere too\nown {i}\nshared {i % 400}", "en", "s", 0) for i in range(1200)] + [(None, "everywhere\nown", "en", "s", 0)] * 2
    out = linededup.drop_frequent_lines(spark.createDataFrame(rows, DOCS).coalesce(1), "doc_id", "text", 10).collect()
    assert len(seen) == linededup.BATCHES >= 8 and all(n > 100 for n, _ in seen)
    assert seen[0][1] == 0 and all(met >= 2 for _, met in seen[1:])
    assert all(r.kept == ("own" if r.doc_id is None else f"own {r.doc_id}\nshared {r.doc_id % 400}") for r in out)


def test_small_runs_have_few_buckets(spark, monkeypatch):
    """Buckets go by a batch's lines, not by the session's shuffle partitions alone."""
    files = []
    whole = linededup.LineRuns._write

    def counted(self, df):
        name = whole(self, df)
        files.append(len(spark.table(name).inputFiles()))
        return name

    monkeypatch.setattr(linededup.LineRuns, "_write", counted)
    rows = [(i, f"everywhere\nown {i}\nshared {i % 400}", "en", "s", 0) for i in range(1200)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    try:
        out = linededup.drop_frequent_lines(spark.createDataFrame(rows, DOCS), "doc_id", "text", 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(out) == 1200 and all(r.kept == f"own {r.doc_id}\nshared {r.doc_id % 400}" for r in out)
    assert len(files) >= linededup.BATCHES and max(files) <= spark.sparkContext.defaultParallelism


def test_carried_columns_must_not_clash(spark):
    with pytest.raises(ValueError, match="kept"):
        linededup.drop_frequent_lines(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, kept string"), "doc_id", "text", carry=("kept",))


def _fingerprint(text: str | None, n: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in (None, "", " \t", "a", "A b c", "a b c d", "É x Y z w v u", "a b c d " * 50, "x\x85y z\xa0w q"):
        assert simhash.fingerprint(text) == _fingerprint(text, 4)


def test_links_are_all_pairs(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(4):
            for _ in range(rng.randint(1, 6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [simhash._signed(f) for f in fps]
    expected = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected
    assert expected
    for k in (1, 2, 4, 5):
        some = {(a, b) for a, b in expected if bin((a ^ b) & (1 << 64) - 1).count("1") <= k}
        deep = [tuple(r) for r in simhash.deep_links(spark.createDataFrame([(s,) for s in signed], "fp long"), k).collect()]
        assert len(deep) == len(set(deep))
        assert {p for p in deep if bin((p[0] ^ p[1]) & (1 << 64) - 1).count("1") <= 4} == some  # by longer keys the same


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(-5, 300), (300, -5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base, 1), (3, base + " end", 1), (9, base.upper(), 1), (7, "other words here now", 1), (2, None, 1), (4, "", 1), (8, base, 1), (None, base, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    fp = {r[0]: f"{_fingerprint(r[1], 4):016x}" for r in rows}
    near = bin(int(fp[3], 16) ^ int(fp[5], 16)).count("1") <= 4
    assert got == {(5, fp[5]): 3 if near else 5, (3, fp[3]): 3, (9, fp[9]): 3 if near else 5, (7, fp[7]): 7, (2, "0" * 16): 2, (4, "0" * 16): 2, (8, fp[8]): 3 if near else 5, (None, fp[None]): 3 if near else 5}
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_shards(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 400), 1) for i in range(2000)] + [(3000 + i, "the same text", 1) for i in range(1000)] + [(None, None, 1), (1, "y", 1)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int"), "doc_id", "text", 8, 16).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r)
    assert set(slots) == set(range(8))
    for own in slots.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sums = [sum(r["size"] for r in own) for own in slots.values()]
    assert max(sums) < 1.1 * min(sums)
    copies = Counter(r.shard for r in out if r.doc_id and r.doc_id >= 3000)
    assert max(copies.values()) < 400  # a third of all rows isn't one group
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_placing():
    items = np.random.default_rng(1).random((500, 3))
    at = sharding.place(items, 10)
    load = np.array([items[at == k].sum(0) for k in range(10)])
    assert (load.max(0) / load.min(0) < 1.15).all()


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 1.5, 2) == []


def test_draw_meets_quotas():
    quotas = np.array([1000, 0, 37, 1])
    counts = mixing.draw(quotas, 7, 1)
    assert (counts.sum(0) == quotas).all()
    assert len(set(counts[:, 0])) > 1


def test_permutation():
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(mixing.permuted(np.arange(1000), 1000, 5)) != list(mixing.permuted(np.arange(1000), 1000, 6))


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 50 == 0 else " ".join(rng.choices("abc", k=rng.randint(0, 80))), rng.choice(["s0", "s0", "s1", None]), 1) for i in range(400)] + [(7, "a b", "s1", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    out = mixing.mix(df, "doc_id", "text", "source").collect()
    assert len(out) == len(rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        by[r.target][0] += r.taken
        by[r.target][1] = r.target
    assert all(abs(t - aim) <= 0.03 * aim for t, aim, _ in by.values())
    again = mixing.mix(df.repartition(3), "doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r.taken) for r in out) == Counter((r.doc_id, r.taken) for r in again)
    texts = mixing.mixed_texts(df, "text", "source").collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(r.taken for r in out)
    assert mixing.mix(df.limit(0), "doc_id", "text", "source").count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string"), "doc_id", "text", "source").collect()[0].taken == 0


def test_mix_query(spark):
    """Sizes, source sizes and targets of the whole query, counted by hand."""
    from binomia.llm.q_mixing import op7_mix

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    n = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    held = defaultdict(int)
    for d in docs:
        held[d.source] += n[d.doc_id]
    names = sorted(held, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight, aim, open_, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, list(names), 1.5 * sum(held.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * held[s]]
        aim.update({s: 2.0 * held[s] for s in full} if full else share)
        left -= sum(aim[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    source, taken = {d.doc_id: d.source for d in docs}, defaultdict(int)
    rows = op7_mix(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (n[r.doc_id], held[s]) and r.target == pytest.approx(aim[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - aim[s]) <= 0.02 * aim[s] + 64 for s in names)


def test_mix_of_many_sources_and_long_texts(spark):
    rows = [(i, f"a{i} b c", f"s{i}", "x", 1) for i in range(12_000)] + [(20_000, "w " * 300_000, "long", "x", 1), (None, None, None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, size int")
    out = mixing.mix(df, "doc_id", "text", "source").collect()
    assert len(out) == len(rows)
    texts = mixing.mixed_texts(df, "text", "source").collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(r.taken for r in out)
    assert {r.row for r in texts} == {"x"}  # columns of any name pass


def test_shards_query(spark):
    """The whole query against sizes and checksums by hand."""
    import zlib

    from binomia.llm.q_shard import op9_shards

    folder = "/root/testdata/sf0.001"
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_shards(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mix_keeps_repeated_empty_rows(spark):
    rows = [(i, "a b c " * 5, "s0") for i in range(20)] + [(7, "", "s0")] * 3 + [(8, None, "s0")] * 2 + [(None, " ", "s0")] * 4 + [(None, "x y", "s0")] * 2
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    count = Counter((r.doc_id, r["size"]) for r in out)
    assert len(out) == len(rows)
    assert (count[7, 0], count[8, 0], count[None, 0], count[None, 2]) == (3, 2, 4, 2)
    assert all(r.taken == 0 for r in out if r["size"] == 0)
