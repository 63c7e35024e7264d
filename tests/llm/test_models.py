"""Packing, LM scoring, quality and neighbours against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from binomia.llm import ann, lm, packing, quality, trie
from binomia.llm.fastbpe import word_table
from binomia.llm.q_packing import vocabulary
from binomia.llm.words import word_keys

DIR = "/root/testdata/sf0.001"


def test_bpe_is_the_tokenizers():
    table = word_table(vocabulary())
    rng = random.Random(1)
    letters = list("ab s't'rellvemd'' \n\t 12é²Ⅷ!?.   漢🙂'\x1c\x85\xa0<|endoftext|>")
    texts = ["", " ", "it's we'll I'd 'tis ''s", *("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000))]
    ids, at = table.encode(texts)
    for i, t in enumerate(texts):
        assert list(ids[at[i] : at[i + 1]]) == table.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_bin_bounds():
    rng = random.Random(2)
    for size in (10, 64):
        for _ in range(60):
            lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(1, 9))])
            bins, offsets, room = packing.best_fit_decreasing(lengths, size)
            best = _optimum(sorted(lengths.tolist(), reverse=True), size)
            assert packing.lower_bound(np.bincount(lengths, minlength=size + 1), size) <= best <= len(room)
            for b in range(len(room)):
                own = np.flatnonzero(bins == b)
                own = own[np.argsort(offsets[own])]
                assert list(offsets[own]) == [int(lengths[own[:k]].sum()) for k in range(len(own))]
                assert lengths[own].sum() + room[b] == size


def _optimum(lengths: list[int], size: int) -> int:
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, size - lengths[i]])

    go(0, [])
    return best[0]


def test_packing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", F.lit(1).alias("length"))
    extra = spark.createDataFrame([(None, None, 1), (-1, "", 1), (-1, "", 1), (-2, "word " * 5000, 1)], "doc_id long, text string, length int")
    items = packing.pieces(docs.union(extra), "doc_id", "text", vocabulary(), 1024, 2)
    out, report = packing.pack(items, 1024, partition_items=60)
    rows = out.collect()
    tok = word_table(vocabulary()).tokenizer
    texts = {r.doc_id: r.text or "" for r in docs.union(extra).collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.id].append(r)
    for d, own in by_doc.items():
        if d == -1:
            assert [(r.start, r.length) for r in own] == [(0, 1), (0, 1)]
            continue
        ids = np.array([*tok.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 1024
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(np.bincount(lengths, minlength=1025), 1024) <= len(by_seq) < report[0][0]  # small partitions exchange pieces and save bins
    assert len(report) > 1
    assert packing.pack_documents(docs.limit(0), "doc_id", "text", vocabulary()).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(3)
    for top, n in ((5, 0), (1, 5), (5000, 2000), (10**12, 300), (200, 2000)):
        v = np.sort(rng.integers(0, top, n))
        e = trie.EliasFano.of(v)
        x = rng.integers(0, top + 10, 500)
        assert (e.successor(x) == np.searchsorted(v, x)).all()
        assert (e.access(np.arange(n)) == v).all()


def _brute_lm(tokens: dict, held: set):
    """log10 probabilities of a Witten-Bell trigram model over additive unigrams."""
    one, two, three = Counter(), defaultdict(Counter), defaultdict(Counter)
    for d, t in tokens.items():
        if d not in held:
            one.update(t)
            for u, v, w in zip(["B", "B", *t], ["B", *t], t, strict=False):
                two[v][w] += 1
                three[u, v][w] += 1
    n, size = sum(one.values()), len(one)

    def score(t):
        out = 0.0
        for u, v, w in zip(["B", "B", *t], ["B", *t], t, strict=False):
            p = (one[w] + 0.1) / (n + 0.1 * (size + 1))
            for c in (two.get(v), three.get((u, v))):
                if c:
                    p = (c[w] + len(c) * p) / (sum(c.values()) + len(c))
            out += math.log10(p)
        return out

    base = lambda t: sum(math.log10((one[w] + 0.1) / (n + 0.1 * (size + 1))) for w in t)
    return one, n, base, score


def test_lm(spark):
    rng = random.Random(4)
    words = ["The", "of", "é", "a", "b", "c", *(f"w{i}" for i in range(60))]
    texts = {i: None if i == 3 else "" if i == 4 else " \t".join(rng.choices(words, k=rng.randint(1, 60), weights=[30, 20, 10, *[1] * 63])) for i in range(120)}
    texts[200] = "only here unseen " * 3
    held = {i for i in texts if i % 10 == 0}
    tokens = {i: [*(t or "").encode().lower().split(), 1] for i, t in texts.items()}
    one, n, base, score = _brute_lm(tokens, held)
    df = spark.createDataFrame([(i, t, i in held, 1) for i, t in texts.items()], "doc_id long, text string, h boolean, score int")
    rows = {r.doc_id: r for r in lm.score(df, "doc_id", "text", "h", chunk=500, shard=10**7).collect()}  # several chunks, one shard: no class is split
    assert set(rows) == set(texts)
    for i, r in rows.items():
        t = tokens[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in one for w in t), n, i in held)
        assert math.isclose(r.base_score, base(t), rel_tol=1e-9)
        assert abs(r.score - score(t)) < 0.002 * len(t)
    split = {r.doc_id: r for r in lm.score(df.repartition(3), "doc_id", "text", "h", chunk=500, shard=300).collect()}  # many shards, split words
    assert all(math.isclose(split[i].base_score, r.base_score, rel_tol=1e-9) for i, r in rows.items())
    assert all(abs(split[i].score - r.score) < 0.002 * len(tokens[i]) for i, r in rows.items())  # shards are layout alone, but for rounding
    assert lm.score(df.limit(0), "doc_id", "text", "h").count() == 0


def test_trie_sums_to_one():
    rng = np.random.default_rng(5)
    t = np.unique(np.stack([rng.integers(0, 9, 3000), rng.integers(0, 40, 3000), rng.integers(0, 50, 3000)], 1), axis=0)
    p1 = rng.random(50)
    model = trie.Trie.mapped(trie.build(t[:, 0], t[:, 1], t[:, 2], rng.integers(1, 9, len(t)), p1 / p1.sum()))
    for r, u in ((0, 0), (3, 39), (8, 7), (20, 1)):
        assert abs((10 ** model.score(np.full(50, r), np.full(50, u), np.arange(50))).sum() - 1) < 0.002


def test_trie_file(tmp_path):
    block = trie.build(np.array([1, 1]), np.array([0, 2]), np.array([1, 2]), np.array([3, 4]), np.array([0.2, 0.3, 0.5]))
    (tmp_path / "t").write_bytes(block)
    args = np.array([1, 1, 5]), np.array([0, 0, 0]), np.array([1, 2, 1])
    assert (trie.Trie.open(str(tmp_path / "t")).score(*args) == trie.Trie.mapped(block).score(*args)).all()


def test_word_keys():
    raw = [t.encode() for t in ("Hello  World\n foo", "", "hello", " a", "É é", "x" * 500 + " Foo", "a\x85b")]
    keys, before = word_keys(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    words = [w for r in raw for w in r.lower().split()]
    assert list(np.diff(before)) == [len(r.split()) for r in raw]
    assert len(set(keys.tolist())) == len(set(words))
    assert len({(w, k) for w, k in zip(words, keys.tolist(), strict=True)}) == len(set(words))


def test_em_finds_accuracies():
    rng = np.random.default_rng(6)
    truth = rng.random(20000) < 0.2
    acc = (0.95, 0.9, 0.85)
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) for a in acc] + [np.full(20000, quality.ABSTAIN)], 1).astype(int)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table, p = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.2) < 0.02
    assert all(abs(table[j, 1, 1] - a) < 0.03 for j, a in enumerate(acc))
    assert ((p[which.ravel()] > 0.5) == truth).mean() > 0.95


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("keep"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None, 1), (-1, "", 1), (-2, " \n", 1)], "doc_id long, text string, keep int")
    model = quality.fit(docs.union(odd), "doc_id", "text", labels)
    out = quality.classify(docs.union(odd), "text", model)
    assert out.where("doc_id is null or doc_id < 0").agg(F.min(F.col("keep").cast("int"))).first()[0] == 1
    judged = out.join(labels, "doc_id")
    assert judged.where("quality = 1 and toxic = 0 and not keep").count() <= 0.01 * judged.count()
    assert judged.where("quality = 0 and not keep").count() >= 0.8 * judged.where("quality = 0").count()
    unlabelled = quality.fit(docs, "doc_id", "text", None)
    assert quality.classify(docs, "text", unlabelled).where("keep").count() > 500
    empty = docs.limit(0)
    assert quality.classify(empty, "text", quality.fit(empty, "doc_id", "text", labels)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 12)).astype(np.float32)
    x[500:560] = x[500]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2100, [0.0] * 12, 1), (2200, [float("nan")] * 12, 1), (2300, [1.0, 2.0], 1), (2400, [None] + [1.0] * 11, 1), (2500, [float("inf")] * 12, 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, "vec_id", "embedding", lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(900), d))[:10].tolist()))
        assert all(math.isclose(s, d[v], rel_tol=1e-12, abs_tol=1e-12) for v, s in found)
        assert found == sorted(found, key=lambda p: (p[1], p[0]))
    assert hits >= 0.95 * 90
    assert [v for v, _ in got[500]] == list(range(501, 511))
    few = ann.nearest_neighbours(df.where("vec_id < 4"), "vec_id", "embedding", lambda i: i % 100 == 0).collect()
    assert len(few) == 3
    assert ann.nearest_neighbours(df.limit(0), "vec_id", "embedding", lambda i: i % 100 == 0).count() == 0


def test_lm_over_shards(spark):
    rng = random.Random(8)
    words = ["the", "of", "a", *(f"w{i}" for i in range(60))]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 60), weights=[30, 20, 10, *[1] * 60])) for i in range(150)}
    texts[200] = "only here unseen the unseen of w1"
    held = {i for i in texts if i % 10 == 0}
    tokens = {i: [*t.encode().split(), 1] for i, t in texts.items()}
    one, n, base, score = _brute_lm(tokens, held)
    df = spark.createDataFrame([(i, t, i in held) for i, t in texts.items()], "doc_id long, text string, h boolean").repartition(3)
    for shard in (300, 40):
        rows = lm.score(df, "doc_id", "text", "h", chunk=500, shard=shard).collect()
        assert {r.doc_id for r in rows} == set(texts)
        for r in rows:
            t = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in one for w in t), n)
            assert math.isclose(r.base_score, base(t), rel_tol=1e-9)
            assert abs(r.score - score(t)) < 0.002 * len(t)  # a frequent word's back-off knows all its followers


def _recall(spark, x: np.ndarray, queries: range) -> float:
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest_neighbours(df, "vec_id", "embedding", lambda i: i.isin(list(queries))).collect():
        got[r.query_id].add(r.vec_id)
    hits, x = 0, x.astype(float)
    for q in queries:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    return hits / (10 * len(queries))


def test_neighbours_of_any_norm(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2500, 12)).astype(np.float32)
    x[7] *= 1e6  # one of far larger norm
    assert _recall(spark, x, range(0, 2500, 125)) >= 0.95
    near = rng.standard_normal((50, 12))[np.arange(2500) % 50] + 1e-4 * rng.standard_normal((2500, 12))
    assert _recall(spark, near.astype(np.float32), range(0, 2500, 125)) >= 0.95  # tight clusters


def test_quality_learns_rare_words(spark):
    rng = np.random.default_rng(10)
    target = np.zeros(4000)
    target[:12] = 1
    features = [(np.append(np.unique(rng.integers(100, 200, 5)), [7] if t else []).astype(np.int64), np.ones(5 + int(t))) for t in target]
    features = [(i, h[: len(i)]) for i, h in features]
    weights = quality.train(features, target)
    assert weights[7] > 1 and weights[7] + weights[-1] > 0  # in 0.3 % of the texts, all of them bad
    rng = random.Random(10)
    slurs = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(700)]
    labelled = spark.createDataFrame([(f"so {w} there", 1) for w in slurs for _ in range(5)] + [("so good there", 0)] * 8000, "t string, toxic int")
    assert len(quality.toxic_stems(labelled)) >= 1300  # two beginnings a word


def test_quality_on_labels_not_seen(spark):
    """Half the labels teach; the others, of other texts, judge."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").repartition(4, "doc_id")
    judged = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").join(docs, "doc_id").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))).drop("text")
    out = quality.classify(docs, "text", quality.fit(docs, "doc_id", "text", judged.where("half = 0").drop("half"))).drop("text")
    rows = {(r.quality, r.toxic): (r.n, r.gone) for r in judged.where("half = 1").join(out, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(~F.col("keep")).alias("gone")).collect()}
    share = {k: gone / n for k, (n, gone) in rows.items()}
    assert share[1, 0] <= 0.02  # clean
    assert share[1, 1] >= 0.8 and share[0, 0] >= 0.9


def test_quality_posterior_is_bayes():
    """EM's posterior is that of its own accuracies, worked out by hand."""
    patterns, counts = np.array([[1, 1, 2], [0, 0, 2], [1, 0, 2], [0, 1, 1], [2, 2, 0], [1, 1, 1]]), np.array([50.0, 800.0, 20.0, 10.0, 100.0, 20.0])
    prior, table, p = quality.estimate(patterns, counts)
    for row, got in zip(patterns, p, strict=True):
        bad, good = prior, 1 - prior
        for j, v in enumerate(row):
            if v != quality.ABSTAIN:
                bad, good = bad * table[j, 1, v], good * table[j, 0, v]
        assert math.isclose(got, bad / (bad + good), rel_tol=1e-5)


def test_linear_is_a_sum_by_hand():
    rng = np.random.default_rng(11)
    weights = np.where(rng.random(2**quality.BITS + 1) < 0.01, rng.standard_normal(2**quality.BITS + 1), 0)
    texts = ["", "a b c a b", " ".join(f"w{i % 700}" for i in range(900)), "x"]
    raw = [t.encode() for t in texts]
    w = quality.Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    got, f, whole = quality.linear(w, weights[None])[0], w.features(), w.text_features()
    for k, (a, b) in enumerate(zip(w.before, w.before[1:], strict=False)):
        own = sum(weights[i] for i in set(f[a:b].ravel().tolist())) / math.sqrt(max(1, (b - a) / quality.LONG))
        assert math.isclose(got[k], own + sum(weights[i] for i in whole[k].tolist()) + weights[-1], abs_tol=1e-9)
