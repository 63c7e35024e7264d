"""The pipeline's stages over the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from binomia.llm import quality, simhash
from binomia.llm.common import written

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, DIR), f"test-{name}")
        assert docs.columns == list(cp.COLUMNS)
        kept[name] = docs.count()
        if name == "line_dedup":
            assert kept[name] == before.count()
        if name == "simhash":
            assert docs.join(before, ["doc_id", "text"], "left_anti").count() == 0
            assert docs.groupBy("text").count().where("count > 1").count() == 0
        if name == "mix":
            words = lambda d: d.agg(F.sum(F.size(F.split(F.trim("text"), "\\s+")))).first()[0]
            assert abs(words(docs) / words(before) - 1.5) < 0.05
    out = cp.STAGES[-1][1](spark, docs, DIR)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def test_stages_with_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", "en", "s", 0), (2, "a plain text of some words that is kept", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, DIR), "test-nulls")
    assert docs.where("doc_id = 2").count() >= 1


@pytest.fixture
def some(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*cp.COLUMNS)
    long = spark.createDataFrame([(9001, "shared line\n" + "long " * 60_000, "en", None, None), (9002, None, None, None, None), (None, "", "en", "s", 0), (9003, "shared line\nSHARED LINE \nown", "en", "s", 1)], docs.schema)
    return docs.unionByName(long).unionByName(docs.limit(7))


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_quality_stage(spark, some):
    """What stays is what the model's own scores keep, as they are."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality", "toxic")
    model = quality.fit(some, "doc_id", "text", labels)
    scored = quality.classify(some, "text", model)
    expected = sorted(map(repr, map(tuple, scored.where("keep").select(*cp.COLUMNS).collect())))
    assert sorted(map(repr, map(tuple, cp.quality_stage(spark, some, DIR).collect()))) == expected
    assert scored.where("not keep and junk_score < 0.5 and toxic_score < 0.95").count() == 0


def test_line_stage(spark, some):
    """Lines in ten different texts go from all but the first of these."""
    rows = some.collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r.text or ""].append(r.doc_id)
    holders = defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            if _key(line):
                holders[_key(line)].add(t)
    often = {k for k, v in holders.items() if len(v) >= 10}
    got = defaultdict(list)
    for r in cp.line_stage(spark, some, DIR).collect():
        got[r.doc_id].append(r.text)
    least = {t: min((x is not None, x or 0) for x in ids) for t, ids in texts.items()}
    gone = 0
    for r in rows:
        kept = []
        for line in (r.text or "").split("\n"):
            k = _key(line)
            first = k in often and (r.doc_id is not None, r.doc_id or 0) == min(least[t] for t in holders[k])
            gone += k in often and not first
            kept += [line] if k not in often or first else []
        assert "\n".join(kept) in got[r.doc_id]
    assert gone and sum(map(len, got.values())) == len(rows)


def test_simhash_stage(spark, some):
    """One row of each group of linked fingerprints, by all pairs."""
    rows = some.collect()
    prints = {simhash.fingerprint(r.text, 4) for r in rows}
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    groups = defaultdict(set)
    for r in rows:
        groups[find(simhash.fingerprint(r.text, 4))].add((r.doc_id, r.text))
    out = [(r.doc_id, r.text) for r in cp.simhash_stage(spark, some, DIR).collect()]
    assert len(out) == len(groups)
    assert all(sum(o in g for o in out) == 1 for g in groups.values())


def test_mix_and_pack_stages(spark, some):
    """Words drawn are runs of the texts' own words, twice each at most; packed pieces are those of the texts, in order."""
    whole = defaultdict(list)
    for r in some.collect():
        whole[r.doc_id, r.source].append((r.text or "").split())
    mixed = cp.mix_stage(spark, some, DIR)
    rows, passes = mixed.collect(), defaultdict(int)
    for r in rows:
        words = r.text.split()
        assert r.n_chars == len(r.text)
        assert any(_within(words, own) for own in whole[r.doc_id, r.source])
        passes[r.doc_id, r.source] += 1
    assert all(n <= 2 * len(whole[k]) for k, n in passes.items())
    total, drawn = sum(len(w) for v in whole.values() for w in v), sum(len(r.text.split()) for r in rows)
    assert abs(drawn / total - 1.5) < 0.05
    packed = cp.pack_stage(spark, mixed.select(*cp.COLUMNS), DIR).collect()
    at = defaultdict(list)
    for r in packed:
        at[r.sequence_id].append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(own)[:i]) for own in at.values() for i, (o, _) in enumerate(sorted(own)))
    assert max(sum(n for _, n in own) for own in at.values()) <= 1024


def _within(words, own):
    """Whether words are some of own, in their order."""
    it = iter(own)
    return all(w in it for w in words)
