"""Spelling variants against brute force: every pair of words compared."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from binomia.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _lower(word: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def _one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _plain(rows: list[tuple], modulus: int = 31, least: int = 7, often: int = 2, ratio: int = 10) -> set[tuple]:
    held: Counter = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            word = _lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{word}".encode())
            if h % modulus == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            held[word] += 1
    n = {w: c for w, c in held.items() if len(w) >= least and c >= often}
    near = {w: [x for x in n if _one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def _texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["Grammar", "grammatik", "Übergänge", "interval", "abababab", "aaaaaaaa", "ÿÀÿÀÿÀÿ", "separate"]

    def word() -> str:
        w = rng.choice(stems)
        if rng.random() < 0.3:
            for _ in range(rng.choice([1, 1, 2])):
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "é", w[k] + "b"]) + w[k + 1 :]
        return w

    rows = [(i, " ".join(word() + rng.choice(["", ",", "1x", "×", "Ā", "-"]) for _ in range(60)), "w", 1) for i in range(120)]
    rows += [(1000 + i, "separate " * 40 + "separata " * 2, "w", 1) for i in range(8)]
    return rows + rows[:2] * 2 + [(None, "grammatiks grammatiks", "w", 1), (None, None, None, None), (7, "", "w", 1), (8, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999 + "é zz", "w", 1), (9, "z" * 5001, None, 1)]


def test_variants_against_brute_force(spark):
    rows = _texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.group_spellings(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _plain(rows)
    assert spelling.group_spellings(df.limit(0), "doc_id", "text").count() == 0


def test_chains_are_followed_to_the_last(spark):
    words = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 10_000), ("aaabbb", 3), ("zzzzzzz", 5), ("zzzzzzy", 50), ("zzzzzyz", 50)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaabbbb")
    assert got["aaaaabb"] == ("aaaabbb", "aaabbbb")
    assert got["aaabbb"] == ("aaabbbb", "aaabbbb")
    assert got["zzzzzzz"] == ("zzzzzyz", "zzzzzyz")  # a tie: the smaller word
    assert got["aaabbbb"] == (None, "aaabbbb")


@pytest.mark.parametrize("seed", [2, 3])
def test_pairs_are_all_pairs_once(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(250)} | {"".join(rng.choices("aé𝄞", k=rng.randint(7, 9))) for _ in range(250)}
    expected = {frozenset((a, b)) for a in words for b in words if _one_edit(a, b)}
    got = [frozenset((r.a, r.b)) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_checksums_continue_a_prefix():
    low = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    start, stop = np.array([0, 3, 8, 10]), np.array([3, 3, 200, 318])
    begun = np.array([zlib.crc32(b"12:"), 0, 7, zlib.crc32(b"x")], np.uint32)
    assert spelling.checksums(low, start, stop, begun).tolist() == [zlib.crc32(low[a:z].tobytes(), int(b)) for a, z, b in zip(start, stop, begun, strict=True)]
