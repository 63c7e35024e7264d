"""Throttling and the log's streams against plain versions."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from binomia.operators import throttle
from binomia.streaming import events as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, part int, kind string"


@pytest.fixture
def many_partitions(spark):
    """As on a cluster: partitions aren't joined because they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _plain(rows: list[tuple], gap: float) -> Counter:
    last: dict = {}
    out: Counter = Counter()
    for user, event, ts, *_ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1] is not None, r[1] or 0)):
        if user not in last or (ts - last[user]).total_seconds() >= gap:
            last[user] = ts
            out[user, event, ts] += 1
    return out


def _rows(seed: int, n: int, users: list, span: int, step: float = 1.0) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.choice(users), i, START + dt.timedelta(seconds=rng.randrange(span) * step), 1, "x") for i in range(n)]


@pytest.mark.parametrize(("users", "span", "step", "gap"), [([1], 5000, 1.0, 60), ([1], 900, 1.0, 2000), ([1], 40, 30.0, 60), ([1, 1, 1, 2, 3, None], 5000, 0.5, 7), ([1], 1, 1.0, 60), (list(range(300)), 800, 1.0, 50)])
def test_throttling_of_any_users(many_partitions, users, span, step, gap):
    rows = _rows(1, 3000, users, span, step) + [(1, None, START, 1, "x"), (5, 1, None, 1, "x")]
    got = throttle.rate_limited(many_partitions.createDataFrame(rows, SCHEMA), gap)
    assert Counter((r.user_id, r.event_id, r.ts) for r in got.collect()) == _plain(rows, gap)


def test_one_user_is_spread_over_tasks(many_partitions):
    rows = _rows(2, 20_000, [7], 100_000)
    got = throttle.rate_limited(many_partitions.createDataFrame(rows, SCHEMA), 30)
    assert Counter((r.user_id, r.event_id, r.ts) for r in got.collect()) == _plain(rows, 30)
    spread = many_partitions.createDataFrame(rows, SCHEMA).repartitionByRange("user_id", "ts").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 9 and max(r["count"] for r in spread) < 4000


def test_no_gap_and_no_events(spark):
    df = spark.createDataFrame([(1, 1, START, 1, "x"), (1, 2, START, 1, "x"), (1, 3, None, 1, "x")], SCHEMA)
    assert throttle.rate_limited(df, 0).count() == 2
    assert throttle.rate_limited(df.limit(0), 5).count() == 0


def test_pointers():
    rng = np.random.default_rng(3)
    t = np.unique(rng.integers(0, 400, 150))
    user = np.sort(rng.integers(0, 3, len(t)))
    step = throttle.next_accepted(user, t, 20)
    for i in range(len(t)):
        assert step[i] == next((j for j in range(i + 1, len(t)) if user[j] == user[i] and t[j] >= t[i] + 20), len(t))
    chain, at = [], 0
    while at < len(t):
        chain.append(at)
        at = int(step[at])
    assert np.flatnonzero(throttle.followed(step, np.array([0]))).tolist() == chain
    assert throttle.last_of_chain(step)[0] == chain[-1]


def _files(spark, tmp_path, rows: list[tuple], parts: int, schema: str = SCHEMA) -> str:
    """Rows as files in a shuffled order, one a micro-batch."""
    path = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_throttled_stream_of_shuffled_files(many_partitions, tmp_path):
    spark = many_partitions
    rows = _rows(4, 600, [1, 1, 1, 2, None], 4000)
    random.Random(5).shuffle(rows)
    stream = S.event_stream(spark, _files(spark, tmp_path, rows, 4), files_a_batch=1)
    out = S.throttled(stream, 60, 5000, str(tmp_path / "run"))
    assert Counter((r.user_id, r.event_id, r.ts) for r in out.accepted().collect()) == _plain(rows, 60)
    assert out.ledger.read("late").count() == 0 and out.ledger.read("pending").count() == 0


def test_throttled_stream_keeps_little(spark, tmp_path):
    """Files in order but for a few seconds: what waits is as long as the lateness, and users of long ago are forgotten; a step repeated changes nothing."""
    rows = sorted(_rows(6, 900, list(range(200)), 9000), key=lambda r: r[2].timestamp() // 20 + random.Random(r[1]).random())
    schema = "user_id long, event_id long, ts timestamp"
    t = S.Throttled(spark, str(tmp_path / "t"), schema, 60, 40)
    for k in range(6):
        step = spark.createDataFrame([r[:3] for r in rows[k * 150 : k * 150 + 150]], schema)
        t.step(step, k)
        t.step(step, k)
        assert t.ledger.read("pending").count() <= 20
        assert t.ledger.read("last").count() <= 40
    t.flush()
    assert Counter((r.user_id, r.event_id, r.ts) for r in t.accepted().collect()) == _plain(rows, 60)
    t.step(spark.createDataFrame([(1, 1, START)], schema), S.FLUSH + 1)
    assert t.ledger.read("late").count() == 1


def test_dashboard_stream(spark, tmp_path):
    rng = random.Random(7)
    schema = "event_id long, ts timestamp, lat double, lng double, country string, city string, k long"
    rows = [(i, START + dt.timedelta(seconds=rng.randrange(500)), rng.choice([0.0, 1.0]), 2.0, rng.choice("ab"), rng.choice(["", None, "c"]), rng.choice([None, 3, 900])) for i in range(200)]
    rng.shuffle(rows)
    stream = S.event_stream(spark, _files(spark, tmp_path, rows, 4, schema), files_a_batch=1)
    board = S.Dashboard(spark, str(tmp_path / "t"), schema, F.col("k"), 50)
    board.run(stream, str(tmp_path / "s")).awaitTermination()
    assert board.ledger.read("recent").count() == 50
    last = sorted(rows, key=lambda r: (r[1], r[0]))[-50:]
    shown = board.shown().first()
    assert (shown.sessions, shown.species_total) == (200, sum(r[6] for r in rows if r[6] and r[6] <= 500))
    assert (shown.locations, shown.markers) == (len({(r[5], r[4]) if r[5] else r[4] for r in last}), sum(r[2] != 0 for r in last))
