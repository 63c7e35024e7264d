"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, under their smallest id, so that a common vector neither floods its own neighbourhood nor
a task. The graph starts from random hyperplane leaves (large ones are cut by hash) and improves by NN-descent: each
round, nodes meet the neighbours of their neighbours, forwards and backwards, at the node between them, where at least
one of a pair must be new; a pair nearer than either's worst neighbour goes on. Vectors travel there in the type they are
given in, so that norms of any size keep their distances; hyperplanes pass through the median of each component, which
a few outliers don't move. A search keeps a beam of the nearest nodes seen; each step joins the beam's
unexpanded nodes with the graph and the vectors, and it ends when none is left. A query that is a row starts at its
node, another at a bounded sample of nodes.

Cases: null, zero, and vectors with null or non-finite components or of another length than the most common one take
no part, as rows or queries; ties go to the smaller id; a repeated id's rows are all candidates, for other
ids, and all queries; an id is given once, where it is nearest; with fewer candidates than asked all found are
returned; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binomia.llm.common import drop_written, written

K = 24
TREES = 4
LEAF = 64
LEAF_CUT = 256
ROUNDS = 6
PART_NODES = 4096
BEAM = 256
ENTRIES = 256


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fit = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    fit &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.where(fit)
    common = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vec") == (common[0] if common else 0))


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(a), -1)


def _bytes(column: pa.ChunkedArray, dim: int, kind) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(a.to_pylist()), kind).reshape(len(a), dim)


def _best(a: np.ndarray, b: np.ndarray, d: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of edges a to b, the k nearest of each a, once each; an edge that is there already isn't new."""
    order = np.lexsort((d, new, b, a))  # an edge's distance may differ in its last bits
    a, b, d, new = a[order], b[order], d[order], new[order]
    own = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    a, b, d, new = a[own], b[own], d[own], new[own]
    order = np.lexsort((b, d, a))
    a, b, d, new = a[order], b[order], d[order], new[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))[: len(a)]
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    own = rank < k
    return a[own], b[own], d[own], new[own]


EDGE = "a long, b long, d double, new boolean"


def _edges(parts: tuple[np.ndarray, ...]) -> pa.Table:
    a, b, d, new = parts
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "d": pa.array(d, pa.float64()), "new": pa.array(new.astype(bool))})


def _distances(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    n = (x * x).sum(1)
    return np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)


def build_graph(nodes: DataFrame, k: int = K, trees: int = TREES, rounds: int = ROUNDS, seed: int = 11, kind=np.float64) -> DataFrame:
    """Edges (a, b, d): about the k nearest nodes b of each node a. nodes: (id, vec) of distinct vectors, written; kind: a type that holds their components."""
    stats = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    n, dim = stats[0], stats[1] or 1
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-n // PART_NODES))
    bits = max(0, (max(1, n // LEAF)).bit_length() - 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    planes = rng.standard_normal((trees * bits, dim)) if bits else np.zeros((0, dim))
    centre = nodes.select(F.posexplode("vec")).groupBy("pos").agg(F.percentile_approx("col", 0.5, 1000).alias("m")).orderBy("pos").collect()  # dim rows
    middle = np.array([r[1] for r in centre]) if centre else np.zeros(dim)

    def code(batches):
        for b in batches:
            x = _matrix(b.column(1))
            q = x.astype(kind)
            side = ((x - middle) @ planes.T > 0) if bits else np.zeros((len(x), 0), bool)
            for t in range(trees):
                c = (side[:, t * bits : (t + 1) * bits] * (1 << np.arange(bits, dtype=np.int64))).sum(1) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), t), pa.int32()), pa.array(c.astype(np.int64)), pa.array([r.tobytes() for r in q], pa.binary())], names=["id", "tree", "leaf", "q"])

    coded = written(nodes.mapInArrow(code, "id long, tree int, leaf long, q binary"), "ann-leaves")
    vectors = coded.where("tree = 0").select("id", "q")
    sizes = coded.groupBy("tree", "leaf").agg(F.count("*").alias("n")).withColumn("cuts", F.ceil(F.col("n") / LEAF_CUT)).drop("n")
    cut = coded.join(sizes, ["tree", "leaf"]).withColumn("cut", F.pmod(F.xxhash64("tree", "id"), F.col("cuts"))).withColumn("part", F.pmod(F.xxhash64("tree", "leaf", "cut"), F.lit(parts)))

    def begin(table: pa.Table) -> pa.Table:
        group = np.unique(np.stack([table.column(c).to_numpy() for c in ("tree", "leaf", "cut")], 1), axis=0, return_inverse=True)[1].ravel()
        ids, q = table.column("id").to_numpy(), _bytes(table.column("q"), dim, kind)
        order = np.argsort(group, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(own) > 1:
                d = _distances(q[own])
                np.fill_diagonal(d, np.inf)
                m = min(k, len(own) - 1)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                out.append((np.repeat(ids[own], m), ids[own][near].ravel(), np.take_along_axis(d, near, 1).ravel().astype(float)))
        if not out:
            return _edges((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return _edges(_best(a, b, d, np.ones(len(a), bool), k))

    def top_k(table: pa.Table) -> pa.Table:
        return _edges(_best(*(table.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "d", "new")), k))

    def by_node(edges: DataFrame) -> DataFrame:
        return edges.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(parts))).groupBy("part").applyInArrow(top_k, EDGE)

    def meet(table: pa.Table) -> pa.Table:
        """Pairs of a centre's list, one of them new, nearer than the worst neighbour of either."""
        c, m, new, worst = (table.column(x).to_numpy(zero_copy_only=False) for x in ("c", "m", "new", "worst"))
        q = _bytes(table.column("q"), dim, kind)
        order = np.argsort(c, kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
            fresh = new[own].astype(bool)
            if not fresh.any():
                continue
            d = _distances(q[own])
            ok = (fresh[:, None] | fresh[None, :]) & (d < worst[own][:, None])
            np.fill_diagonal(ok, False)
            i, j = np.nonzero(ok)
            i, j = i[m[own][i] != m[own][j]], j[m[own][i] != m[own][j]]
            if len(i):
                out.append((m[own][i], m[own][j], d[i, j].astype(float)))
        if not out:
            return _edges((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)))
        a, b, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return _edges(_best(a, b, d, np.ones(len(a), bool), k))

    edges = written(by_node(cut.groupBy("part").applyInArrow(begin, EDGE)), "ann-graph")
    for _ in range(rounds):
        worst = edges.groupBy("a").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("worst"))
        both = edges.select(F.col("a").alias("c"), F.col("b").alias("m"), "new", "d").unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("m"), "new", "d"))
        lists = both.groupBy("c", "m").agg(F.min("new").alias("new"), F.min("d").alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("new"), "d", "m"))).where(F.col("r") <= 2 * k)
        known = vectors.join(worst, vectors["id"] == worst["a"], "left").select(F.col("id").alias("m"), "q", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        met = lists.join(known, "m").withColumn("part", F.pmod(F.xxhash64("c"), F.lit(parts))).select("part", "c", "m", "new", "worst", "q").groupBy("part").applyInArrow(meet, EDGE)
        after = written(by_node(edges.withColumn("new", F.lit(False)).unionByName(met)), "ann-graph")
        drop_written(edges)
        edges = after
        if after.where("new").count() <= 0.001 * k * n:
            break
    return edges.select("a", "b", "d")


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node, d): the beam of each query. queries: (query, start node or null, vec)."""
    spark = nodes.sparkSession
    both = edges.select("a", "b", "d").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= 2 * K)
    graph = written(ranked.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("near")), "ann-near")
    entries = nodes.orderBy(F.xxhash64("id")).limit(ENTRIES).select(F.col("id").alias("entry"))  # a bounded sample to start from
    asked = written(queries, "ann-queries")
    qv = asked.select("query", F.col("vec").alias("qv"))

    def measure(batches):
        for b in batches:
            if b.num_rows:
                d = _matrix(b.column(3)) - _matrix(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt((d * d).sum(1)))], names=["query", "node", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        with_node = pairs.join(nodes.select(F.col("id").alias("node"), F.col("vec").alias("nv")), "node")
        return with_node.join(qv, "query").select("query", "node", "nv", "qv").mapInArrow(measure, "query long, node long, d double")

    nearest = Window.partitionBy("query").orderBy("d", "node")
    own = asked.where("start is not null").select("query", F.col("start").alias("node"))
    other = asked.where("start is null").select("query").crossJoin(F.broadcast(entries)).select("query", F.col("entry").alias("node"))  # ENTRIES rows on the right
    state = written(measured(own.unionByName(other)).withColumn("done", F.lit(False)), "ann-beam")
    while state.where(~F.col("done")).take(1):  # each step expands every open node, and a beam only gets nearer, so this ends
        front = state.where(~F.col("done")).select("query", "node")
        seen = state.select("query", "node")
        steps_on = front.join(graph, "node").select("query", F.explode("near").alias("node")).distinct().join(seen, ["query", "node"], "left_anti")
        grown = state.withColumn("done", F.lit(True)).unionByName(measured(steps_on).withColumn("done", F.lit(False)))
        after = written(grown.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= beam).drop("r"), "ann-beam")
        drop_written(state)
        state = after
    return state.select("query", "node", "d")


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of each row for which the column is_query(id) holds."""
    rows = written(valid_vectors(df, id_col, vec_col), "ann-rows")
    group = rows.groupBy("vec").agg(F.min("id").alias("least"))
    # a vector's node is its smallest id, and its hash where that id has other vectors too
    firsts = group.groupBy("least").agg(F.min("vec").alias("first")).withColumnRenamed("least", "of")
    node = F.when(F.col("vec") == F.col("first"), F.col("least")).otherwise(F.xxhash64("vec"))
    group = written(group.join(firsts, group["least"] == firsts["of"]).select("vec", node.alias("node")), "ann-groups")
    nodes = written(group.select(F.col("node").alias("id"), "vec"), "ann-nodes")
    kind = np.float32 if df.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    edges = build_graph(nodes, kind=kind)
    # the k + 1 smallest ids of each vector: Spark cuts a common vector's rows to these before the shuffle
    few = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    members = written(few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(group, "vec").select("node", "ids"), "ann-members")
    asked = rows.where(is_query(F.col("id"))).join(group.select("vec", "node"), "vec").select(F.col("id").alias("query"), F.col("node").alias("start"), "vec")
    # equal queries are searched once, under their node
    found = search(asked.select(F.col("start").alias("query"), "start", "vec").distinct(), nodes, edges)
    each = found.join(members, "node").select("query", F.explode("ids").alias("id"), "d").groupBy("query", "id").agg(F.min("d").alias("d"))
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("d", "id"))
    near = each.withColumn("rank", best("query")).where(F.col("rank") <= k + 1).drop("rank")
    hits = asked.select(F.col("query").alias("query_id"), F.col("start").alias("query")).join(near, "query").where("id <> query_id").groupBy("query_id", "id").agg(F.min("d").alias("d"))
    ranked = hits.withColumn("rank", best("query_id")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), F.col("d").alias("score"))
