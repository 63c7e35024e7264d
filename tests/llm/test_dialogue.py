"""Conversation repair against a search over all sequences of edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from binomia.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, key int, cost string"


def _damage(rows: list[tuple]) -> dict:
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _plain(own: list[tuple]) -> tuple:
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in own:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in own if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
    heap, best = [(0, "", 0, "", ())], None
    done = set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        legal = re.fullmatch("(s?(ua)*u?)?", roles)
        if not legal or (i, roles[-2:] if len(roles) > 1 else roles) in done:
            continue
        done.add((i, roles[-2:] if len(roles) > 1 else roles))
        if i == len(own) and re.fullmatch("(s?(ua)+)?", roles):
            best = (cost, audit, lines)
            break
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i < len(own):
            _, role, text = own[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + to[0], (*lines, f"{to}:{text}")))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def _rows(seed: int, n: int, spread: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "x. ", "", " \t", None, "two\nlines.", "é" * 50 + "."]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([None, turn * spread, turn * spread, turn * spread]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]), rng.choice(texts), 1, "x"))
    return rows + rows[:5] + [(9999, 1, "user", "long " * 100_000 + "end.", 1, "x")]


@pytest.mark.parametrize(("seed", "spread", "chunk"), [(1, 1, 4096), (2, 3000, 4096), (3, 1, 2), (4, 5000, 1)])
def test_against_all_edits(spark, monkeypatch, seed, spread, chunk):
    monkeypatch.setattr(dialogue, "CHUNK", chunk)
    rows = _rows(seed, 120, spread)
    got = {r[0]: tuple(r[1:]) for r in dialogue.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    damaged = _damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        expected = _plain(damaged[conv]) if damaged[conv] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
        assert got[conv] == expected, conv


def test_one_conversation_of_many_chunks_equals_one_chunk(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"own {t}.", f"own {t}"]), 1, "x") for t in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = dialogue.repair(df).collect()  # blocks of 4096 turns
    monkeypatch.setattr(dialogue, "CHUNK", 100)
    assert dialogue.repair(df).collect() == whole
    own = _damage(rows)[1]
    assert whole[0].cost == _plain(own)[5] and whole[0].audit == _plain(own)[6]


def test_empty(spark):
    assert dialogue.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distances_by_relaxation():
    rng = random.Random(6)
    for _ in range(200):
        codes = "".join(rng.choices("dsuaoSUAO", k=rng.randint(0, 12)))
        goal = tuple(rng.choice([0, 2, 5, 40, dialogue.FAR]) for _ in range(3)) + (1,)
        n = len(codes)
        dist = [dialogue.FAR] * (4 * n) + list(goal)
        for _ in range(4 * n + 4):
            for i in range(n):
                for _, s, t, cost in dialogue._arcs(codes[i]):
                    dist[4 * i + s] = min(dist[4 * i + s], dist[4 * i + 4 + t] + cost)
                for s in range(4):
                    dist[4 * i + s] = min(dist[4 * i + s], dist[4 * i + dialogue.WANTED[s]] + dialogue.INSERT)
        assert [min(d, dialogue.FAR) for d in dist] == dialogue.distances(codes, goal)
