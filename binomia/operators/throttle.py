"""Throttling: of each user's events, in order of time, those a gap after the last one accepted; any user's events over any number of tasks.

An event that is accepted leads to the next one accepted, whoever comes first: so the events of a user are a forest of pointers, followed
by doubling over whole columns. Events are range-partitioned by user and time; only a partition's first user can have begun in another one.
Of that user a partition gives, for every time of a last event before it, the last one accepted in it: a step function, as rows, with equal steps
merged. A stream over these, in order of partitions, composes the functions, one time in memory; each partition then filters its first user's events alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.functions.shared import written

#: Kinds of rows that the first pass writes.
DONE, OPEN, STEP, ENDS = 0, 1, 2, 3
FOREVER = (1 << 63) - 1


def next_accepted(user: np.ndarray, t: np.ndarray, gap: int) -> np.ndarray:
    """For each event, in order of (user, t), the place of the same user's first one a gap later; their number if there is none."""
    n = len(t)
    later = np.where(t > FOREVER - gap, FOREVER, t + gap)
    times = np.unique(np.concatenate([t, later]))
    key = lambda x: user * np.int64(len(times)) + np.searchsorted(times, x)
    found = np.searchsorted(key(t), key(later))
    same = np.append(user, -1)[found] == user
    return np.where(same & (later < FOREVER), found, n)


def followed(step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which events the pointers lead to from the start's, these included; in a logarithm of the longest chain's passes."""
    n = len(step)
    seen = np.zeros(n + 1, bool)
    seen[start] = True
    jump = np.append(step, n)
    while (jump[:n] < n).any():
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def last_of_chain(step: np.ndarray) -> np.ndarray:
    """The last event that each event's pointers lead to."""
    n = len(step)
    end = np.where(step < n, step, np.arange(n))
    while True:
        further = end[end]
        if (further == end).all():
            return end
        end = further


def _partition(schema: pa.Schema, gap: int, part: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    users = table.column("user_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    user = np.cumsum(np.concatenate([[0], users[1:] != users[:-1]])).astype(np.int64)
    t = table.column("t").combine_chunks().to_numpy(zero_copy_only=False)
    step = next_accepted(user, t, gap)
    first = int(np.searchsorted(user, 1))  # events of the first user
    heads = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
    take = followed(step, heads[1:]) if len(heads) > 1 else np.zeros(len(t), bool)
    kind = np.where(np.arange(len(t)) < first, OPEN, DONE)
    keep = take | (kind == OPEN)
    ends = last_of_chain(step)

    def rows(kinds, upto, since, at) -> pa.RecordBatch:
        picked = table.take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), part), pa.int32()), pa.array(kinds, pa.int32()), picked.column("user_id").combine_chunks(), picked.column("t").combine_chunks(), picked.column("event_id").combine_chunks(), pa.array(upto, pa.int64()), pa.array(since, pa.int64())], schema=schema
        )

    at = np.flatnonzero(keep)
    none = np.zeros(len(at), np.int64)
    yield rows(kind[at], none, none, at)
    if len(heads) == 1:  # one user: what comes out depends on what comes in
        within = int(np.searchsorted(t, min(int(t[0]) + gap, FOREVER), side="left")) + 1  # a last event before the first one here reaches no farther
        to = t[ends[: min(within, len(t))]]
        at = np.flatnonzero(np.append(to[1:] != to[:-1], True))  # up to this time a last event's end leads here
        yield rows(np.full(len(at), STEP), t[at], to[at], at)
    else:
        own = int(ends[heads[-1]])
        at = np.array([0, own])
        yield rows(np.full(2, ENDS), np.arange(2), np.array([t[own]] * 2), at)  # the first user, then the last


def rate_limited(events: DataFrame, gap_s: float) -> DataFrame:
    """(user_id, event_id, ts) accepted when each user's events must be a gap apart, counted from the last one accepted.

    Events of one time come in order of event_id, and only the first of them can be accepted, but with a gap of 0 all. A null user is a user; events without a time are left out.
    """
    kind = events.schema["ts"].dataType.simpleString()
    rows = events.select("user_id", "event_id", "ts").where("ts IS NOT NULL")
    gap = round(gap_s * 1_000_000)
    if gap <= 0:
        return rows
    # the first of each time, summed up before the shuffle; a null event_id comes first
    own = rows.groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min(F.struct(F.col("event_id").isNotNull().alias("named"), "event_id")).alias("e")).select("user_id", "t", "e.event_id")
    ranged = own.repartitionByRange("user_id", "t").sortWithinPartitions("user_id", "t").withColumn("part", F.spark_partition_id())
    ddl = f"part int, kind int, user_id {own.schema['user_id'].dataType.simpleString()}, t long, event_id {own.schema['event_id'].dataType.simpleString()}, upto long, since long"
    arrow = _arrow(ddl)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _partition(arrow, gap, held[0].column(3)[0].as_py(), pa.Table.from_batches(held).select(["user_id", "t", "event_id"]))

    made = written(ranged.mapInArrow(first_pass, ddl), "throttle")
    steps = made.where(F.col("kind").isin(STEP, ENDS)).select("part", "kind", "user_id", "upto", "since").repartition(1).sortWithinPartitions("part", "kind", "upto")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, last): the last event accepted before a partition, of its first user."""
        user, last, part, reached, begun = None, None, None, True, False
        for b in batches:
            out = []
            for p, k, u, upto, since in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:  # its first row; rows of the same one follow in order
                    same = begun and u == user
                    last = last if same else None
                    if same:
                        out.append((p, last))
                    part, user, reached, begun = p, u, False, True
                    ahead = None if last is None else last + gap
                if k == ENDS:
                    user, last, reached = u, since, True
                elif not reached and (ahead is None or ahead <= upto):
                    last, reached = since, True
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], names=["part", "last"])

    before = steps.mapInArrow(compose, "part int, last long")
    open_ = made.where(F.col("kind") == OPEN).select("part", "user_id", "t", "event_id").join(before, "part", "left").repartition("part").sortWithinPartitions("part", "t")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_part(batches):
            t, last = table.column("t").combine_chunks().to_numpy(zero_copy_only=False), table.column("last")[0].as_py()
            start = 0 if last is None else int(np.searchsorted(t, min(last + gap, FOREVER)))
            keep = followed(next_accepted(np.zeros(len(t), np.int64), t, gap), np.arange(start, min(start + 1, len(t))))
            yield from table.select(["user_id", "t", "event_id"]).filter(pa.array(keep)).combine_chunks().to_batches()

    out = made.where(F.col("kind") == DONE).select("user_id", "t", "event_id").unionByName(open_.mapInArrow(second_pass, own.select("user_id", "t", "event_id").schema))
    return out.select("user_id", "event_id", F.timestamp_micros("t").cast(kind).alias("ts"))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one part each, of batches in order of parts."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        part = b.column(b.schema.get_field_index("part")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            piece = b.slice(a, z - a)
            if held and held[0].column(piece.schema.get_field_index("part"))[0].as_py() != part[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)
