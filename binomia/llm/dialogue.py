"""Conversation structure repair: cheapest edits that give a conversation the form (system?(user assistant)+)?, by Dial's shortest paths.

A conversation's rows, in order, and the four states of the form's automaton make a graph: node (row, state), arcs keep, rerole, delete and insert
with costs of 0 to 3. Distances to the end come from a bucket queue (Dial): nodes wait in a ring of as many buckets as the largest
cost asks for. A walk from the start takes, of the tight arcs, the one whose letter comes first, which is the least of all cheapest audits.

A conversation may hold any share of all rows, so it is worked on in chunks of at most CHUNK rows. Rows are numbered within blocks of turns,
duplicates are found by an aggregate over (conversation, role, text hash), and a chunk holds a byte a row. Of a conversation with several chunks each gives the
distances between its 16 pairs of border states, these are folded from the end (a few numbers a chunk), each chunk's walks
from the states it can be entered in are made apart, and a fold from the start picks those that join. Repaired texts are hashed as a sorted stream, one row in memory.

Cases: a null role or text counts as one space; a null conversation id is a conversation; null turns come first, in ties the smaller role and then text; a row without
letters is blank; repeated rows are duplicates, so they are deleted; a conversation none of whose rows is left has zeros and an empty audit; a role of another
initial than s, u and a can't be kept; very long texts are read whole, a row at a time; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from binomia.llm.common import written

STRIP = " \t\n\x0b\x0c\r"
CHUNK = 4096
DELETE, INSERT, RENAME, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 30
#: State after the last row: 0 nothing yet, 1 system, 2 user, 3 assistant. What a row of an initial leads to, and the role asked for.
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
WANTED = (2, 2, 3, 2)
#: From each state to an accepted end by insertions alone.
END = (0, 4, 2, 0)
FORCED = "d"


def _arcs(code: str) -> list[tuple[str, int, int, int]]:
    """(letter, from state, to state, cost) of the arcs over a row, by its code: its initial, upper case if truncated, or FORCED."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if code != FORCED:
        more = TRUNCATED if code.isupper() else 0
        step = STEP.get(code.lower())
        out += [("K", s, step[s], more) for s in range(4) if step and step[s] is not None]
        out += [("R", s, WANTED[s], RENAME + more) for s in range(4)]
    return out


_OVER = {c: _arcs(c) for c in "dsuaoSUAO"}
_BACK = {c: [[(s, cost) for _, s, t, cost in arcs if t == to] for to in range(4)] for c, arcs in _OVER.items()}
_INSERTS = [[s for s in range(4) if WANTED[s] == t] for t in range(4)]
_WALK = {c: [sorted((letter, t, cost) for letter, s, t, cost in [*arcs, *(("I", x, WANTED[x], INSERT) for x in range(4))] if s == state) for state in range(4)] for c, arcs in _OVER.items()}


def distances(codes: str, goal: tuple[int, ...] = END) -> list[int]:
    """Cost from each node (4 * row + state) to the end, whose states cost `goal` more, by a ring of buckets."""
    n = len(codes)
    out = [FAR] * (4 * n + 4)
    seeds = [g for g in goal if g < FAR]
    ring: list[list[int]] = [[] for _ in range(max(DELETE, max(seeds) - min(seeds)) + 1)]
    for s, g in enumerate(goal):
        if g < FAR:
            out[4 * n + s] = g
            ring[g % len(ring)].append(4 * n + s)
    d, waiting = min(seeds), len(seeds)
    while waiting:
        bucket = ring[d % len(ring)]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != d:
                continue
            row, state = divmod(node, 4)
            near = [(4 * row + s, INSERT) for s in _INSERTS[state]] if row < n else []
            if row:
                near += [(4 * row - 4 + s, cost) for s, cost in _BACK[codes[row - 1]][state]]
            for prior, cost in near:
                if d + cost < out[prior]:
                    out[prior] = d + cost
                    ring[(d + cost) % len(ring)].append(prior)
                    waiting += 1
        d += 1
    return out


def walk(codes: str, dist: list[int], state: int, last: bool) -> tuple[str, int, list[str]]:
    """(audit, state at the end, a row's operations): along tight arcs, the first letter of those that are.

    A row's operations: u or a for each turn put in before it, then K, D, or U or A for its new role; the last chunk has one entry more for what is put in at the end.
    """
    audit, ops, own, row = [], [], "", 0
    while row < len(codes):
        at = dist[4 * row + state]
        for letter, to, cost in _WALK[codes[row]][state]:
            ahead = row + (letter != "I")
            if dist[4 * ahead + to] + cost == at:
                break
        audit.append(letter)
        own += {"R": " UA"[to - 1], "I": " ua"[to - 1]}.get(letter, letter)
        if ahead > row:
            ops.append(own)
            own = ""
        row, state = ahead, to
    if last:
        while END[state]:
            state = WANTED[state]
            audit.append("I")
            own += " ua"[state - 1]
        ops.append(own)
    return "".join(audit), state, ops


def between(codes: str) -> list[int]:
    """Costs from each state before the rows to each state behind them, 16 numbers."""
    columns = [distances(codes, tuple(0 if s == t else FAR for s in range(4)))[:4] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def fold_goals(chunks: list[list[int]]) -> list[list[int]]:
    """The cost from each state behind each chunk to the end of the conversation."""
    goals = [list(END)]
    for m in reversed(chunks[1:]):
        goals.append([min(m[4 * s + t] + goals[-1][t] for t in range(4)) for s in range(4)])
    return goals[::-1]


def fold_states(ends: list[list[int]]) -> list[int]:
    """The state in which each chunk is entered, from the states that its walks end in."""
    states = [0]
    for e in ends[:-1]:
        states.append(e[states[-1]])
    return states


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text): the contract's damage by the checksum of conversation and turn; key tells conversations apart, a null one too."""
    words = df.select(_key(conv).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn))).alias("name"))
    kind = F.pmod(F.crc32(F.col("name").cast("binary")), F.lit(20))
    changed = words.withColumn("kind", kind).where("kind <> 0")
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_now = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return changed.select("key", "turn", role_now.alias("role"), text_now.alias("text"), F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def _key(conv: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def _illegal(before: Column, after: Column) -> Column:
    return F.coalesce(~F.concat(before, after).isin("su", "ua", "au"), F.lit(False)).cast("int")


def _rows(damaged: DataFrame) -> DataFrame:
    """Each row with its place (block of turns, number in it), its initial and its own faults."""
    block = F.coalesce(F.shiftright("turn", 12), F.lit(-(1 << 62)))
    order = Window.partitionBy("key", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial, bare = F.left("role", F.lit(1)), F.btrim("text", F.lit(STRIP))
    return (
        damaged.withColumns({"block": block, "initial": initial})
        .withColumns({"at": F.row_number().over(order) - 1, "before": F.lag("initial").over(order), "turn_before": F.lag("turn").over(order)})
        .withColumns({"blank": bare == "", "truncated": (bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")})
        .select("key", "block", "at", "turn", "role", "text", "initial", "blank", "truncated", _illegal(F.col("before"), F.col("initial")).alias("illegal"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).cast("int").alias("new_turn"))
    )


def _map(df: DataFrame, schema: str, row) -> DataFrame:
    """`row` over the rows of a frame, as dicts, some hundred at a time."""
    typed = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                yield from pa.Table.from_pylist([row(r) for r in b.slice(k, 256).to_pylist()], typed).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


_PLACE = "key string, block long, sub int"


def _chunks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, block, sub, codes, last, n_chunks, kept, truncated): a chunk's codes, a letter a row; rows that must go have FORCED."""
    first = rows.where("NOT blank").groupBy("key", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2")).agg(F.min(F.struct("block", "at", "initial", "truncated")).alias("f")).select("key", "f.*")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    sub = F.floor(F.col("at") / CHUNK).cast("int")
    found = first.groupBy("key", "block", sub.alias("sub")).agg(F.collect_list(F.struct((F.col("at") % CHUNK).alias("at"), code.alias("code"))).alias("codes"), F.count("*").alias("kept"), F.sum(F.col("truncated").cast("int")).alias("truncated"))
    order = Window.partitionBy("key").orderBy("block", "sub")
    every = blocks.select("key", "block", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK).cast("int"))).alias("sub"))
    every = every.withColumns({"size": F.least(F.lit(CHUNK), F.col("n") - F.col("sub") * CHUNK), "following": F.lead("sub").over(order), "n_chunks": F.count("*").over(Window.partitionBy("key"))})
    joined = every.join(found, ["key", "block", "sub"], "left")

    def fill(r: dict) -> dict:
        codes = [FORCED] * r["size"]
        for c in r["codes"] or ():
            codes[c["at"]] = c["code"]
        return r | {"codes": "".join(codes)}

    out = joined.select("key", "block", "sub", "size", "codes", F.col("following").isNull().alias("last"), "n_chunks", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("truncated", F.lit(0)).cast("long").alias("truncated"))
    return _map(out, f"{_PLACE}, codes string, last boolean, n_chunks long, kept long, truncated long", fill)


def _listed(chunks: DataFrame, what: str) -> DataFrame:
    """A conversation's chunks in order, with a few numbers each."""
    return chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "sub", what))).alias("chunks"))


def _exploded(listed: DataFrame, fold, name: str, kind: str) -> DataFrame:
    """(key, block, sub, name): `fold` of a conversation's numbers, given back to its chunks."""
    what = listed.schema["chunks"].dataType.elementType.names[-1]

    def row(r: dict) -> dict:
        return {"key": r["key"], "out": [{"block": c["block"], "sub": c["sub"], name: v} for c, v in zip(r["chunks"], fold([c[what] for c in r["chunks"]]), strict=True)]}

    return _map(listed, f"key string, out array<struct<block: bigint, sub: int, {name}: {kind}>>", row).select("key", F.explode("out").alias("o")).select("key", "o.*")


def _audits(chunks: DataFrame) -> DataFrame:
    """(key, block, sub, last, cost, audit, ops) of every chunk; cost is the conversation's in its first chunk."""
    place = ["key", "block", "sub"]
    several = chunks.where("n_chunks > 1")
    inner = _map(several.select(*place, "codes"), f"{_PLACE}, m array<int>", lambda r: {"key": r["key"], "block": r["block"], "sub": r["sub"], "m": between(r["codes"])})
    goals = _exploded(_listed(inner, "m"), fold_goals, "goal", "array<int>")

    def walks(r: dict) -> dict:
        dist = distances(r["codes"], tuple(r["goal"] or END))
        made = [walk(r["codes"], dist, s, r["last"]) for s in (range(4) if r["n_chunks"] > 1 else range(1))]
        return {**{k: r[k] for k in ("key", "block", "sub", "n_chunks", "last")}, "cost": dist[0], "ends": [m[1] for m in made], "walks": [{"audit": m[0], "ops": m[2]} for m in made]}

    made = written(_map(chunks.join(goals, place, "left"), f"{_PLACE}, n_chunks long, last boolean, cost int, ends array<int>, walks array<struct<audit: string, ops: array<string>>>", walks), "walks")
    states = _exploded(_listed(made.where("n_chunks > 1"), "ends"), fold_states, "state", "int")
    taken = F.get("walks", F.coalesce("state", F.lit(0)))
    return made.join(states, place, "left").select(*place, "last", "cost", taken["audit"].alias("audit"), taken["ops"].alias("ops"))


_ROLES = {"u": b"user", "a": b"assistant", "U": b"user", "A": b"assistant"}


def _hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the repaired turns of each conversation as one sorted stream of operations and texts; the table may be of any length."""
    made = audits.select("key", "block", "sub", F.posexplode("ops").alias("pos", "ops")).select("key", "block", (F.col("sub") * CHUNK + F.col("pos")).alias("at"), F.lit(0).alias("kind"), F.col("ops"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("key", "block", "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("ops"), "role", "text")
    stream = made.unionByName(texts).repartition("key").sortWithinPartitions("key", "block", "at", "kind").select("key", "ops", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, empty, own, done = None, hashlib.sha256(), True, "", []

        def put(*parts: bytes) -> None:
            nonlocal empty
            for p in parts if empty else (b"\n", *parts):
                state.update(p)
            empty = False

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["key", "repaired_sha256"])
            done.clear()
            return out

        for b in batches:
            columns = [b.column(k) for k in range(4)]
            for k in range(b.num_rows):
                now, ops, role, text = (c[k].as_py() for c in columns)
                if now != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state, empty = now, hashlib.sha256(), True
                if ops is not None:
                    own = ops[-1:] if ops[-1:] in ("K", "D", "U", "A") else ""
                    for letter in ops[: len(ops) - len(own)]:
                        put(_ROLES[letter], b":")
                elif own != "D":
                    put(role.encode() if own == "K" else _ROLES[own], b":", text.encode())
            if done:
                yield batch()
        if key is not None:
            done.append((key, state.hexdigest()))
        yield batch()

    return stream.mapInArrow(run, "key string, repaired_sha256 string")


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: DataFrame | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of df, after damage() or with the rows of `damaged` (key, turn, role, text)."""
    all_convs = df.groupBy(_key(conv).alias("key")).agg(F.max(conv).alias(conv))
    rows = written(_rows(damage(df, conv, turn, role, text) if damaged is None else damaged), "turns")
    blocks = rows.groupBy("key", "block").agg(
        F.count("*").alias("n"), F.sum(F.col("blank").cast("long")).alias("blank"), F.sum("illegal").alias("illegal"), F.sum("new_turn").alias("turns"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.min_by("initial", "at").alias("opens"), F.max_by("initial", "at").alias("closes"),
    )
    blocks = written(blocks, "blocks")
    order = Window.partitionBy("key").orderBy("block")
    counted = blocks.withColumn("border", _illegal(F.lag("closes").over(order), F.col("opens"))).groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("blank").alias("blank"), (F.sum("illegal") + F.sum("border")).alias("illegal"), (F.max("high") - F.min("low") + 1 - F.sum("turns")).alias("gaps")
    )
    chunks = written(_chunks(rows, blocks), "chunks")
    audits = written(_audits(chunks), "audits")
    kept = chunks.groupBy("key").agg(F.sum("kept").alias("kept"), F.sum("truncated").alias("truncated"))
    whole = audits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "sub", "audit", "cost"))).alias("a")).select("key", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"), F.get("a", F.lit(0))["cost"].alias("cost"))
    out = all_convs.join(counted, "key", "left").join(kept, "key", "left").join(whole, "key", "left").join(_hashed(rows, audits), "key", "left")
    zero = F.lit(0)
    return out.select(
        conv,
        *(F.coalesce(c, zero).cast("long").alias(name) for name, c in (("gaps", F.col("gaps")), ("blank", F.col("blank")), ("duplicate", F.col("n") - F.col("blank") - F.col("kept")), ("truncated", F.col("truncated")), ("illegal", F.col("illegal")), ("cost", F.col("cost")))),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
