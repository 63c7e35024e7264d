"""LM scoring with an Elias-Fano n-gram trie of order 3, dealt over shards.

Texts are read once into chunks of about CHUNK tokens: a dictionary of distinct words and the tokens as numbers of
it. Words' counts are summed over word shards, from each chunk's distinct words, and given back to the chunks.
Each chunk then sends, to the shard of each token's preceding word, its distinct triples with their training
counts, and which triple each token of each text is. A shard builds one trie from the training counts, maps it,
scores every distinct triple by searches in it, and adds the scores up by text. The trie grows with the corpus,
a shard doesn't: there is one for SHARD tokens. The triples of a word that precedes more than a quarter of a shard's
tokens are dealt over shards by the word before it too. This is placement only: such a word's pairs are counted over
all chunks beforehand, from each chunk's distinct ones, and its shards are given the counts and the number of its
followers, so that a score doesn't depend on the number of shards. The begin token is such a word once texts are many;
its triples are dealt by the word after it, and as it has one context, itself, its own counts are that context's too.

What repeats, in a chunk, is sent once, so a word, pair or passage that makes up a third of all rows doesn't
land in one task row by row.

Cases: a null or empty text is the end token alone; a null id counts as an empty text where ids are hashed; repeated
rows are learnt from and scored each; a word not learnt has the unknown word's share; an empty table gives an empty
result; a text longer than a chunk is a chunk of its own. Other columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import release, spans, table_path, utf8, written
from binomia.llm.trie import Trie, build
from binomia.llm.words import mixed, with_ends, word_keys

CHUNK = 2_500_000
SHARD = 2_000_000
BYTES = 1 << 20  # of text at a time
ADD = 0.1


def squeeze(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize
    planes = x.view(np.uint8).reshape(-1, width).T.copy() if len(x) else np.zeros(0, np.uint8)
    return zstandard.compress(planes.tobytes(), 1)


def spread(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    return planes.reshape(kind.itemsize, -1).T.copy().view(kind).ravel() if len(planes) else np.zeros(0, kind)


def chunks(df: DataFrame, id_col: str, text_col: str, held_out: str, chunk: int = CHUNK) -> DataFrame:
    """A row a chunk: distinct keys, commonest first, with training counts; tokens as their numbers; ids, lengths and held flags of the texts."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(held_out).alias("h"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes, held, n, made = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, sizes, held, n, made
            size, flags = np.concatenate(sizes), np.concatenate(held)
            token, distinct = pd.factorize(np.concatenate(keys))
            keys = []
            total = np.bincount(token, minlength=len(distinct))
            order = np.argsort(-total, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            token = rank[token]
            train = np.bincount(token[~np.repeat(flags, size)], minlength=len(distinct))
            row = {
                "chunk": pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), "n": pa.array([len(token)], pa.int64()), "n_train": pa.array([int(train.sum())], pa.int64()), "begun": pa.array([int((~flags).sum())], pa.int64()),
                "keys": pa.array([distinct[order].tobytes()], pa.binary()), "train": pa.array([squeeze(train.astype(np.uint32))], pa.binary()), "tokens": pa.array([squeeze(token.astype(np.uint32))], pa.binary()),
                "ids": pa.LargeListArray.from_arrays([0, len(size)], pa.concat_arrays(ids)), "sizes": pa.array([squeeze(size.astype(np.uint32))], pa.binary()), "held": pa.array([squeeze(flags.astype(np.uint8))], pa.binary()),
            }
            ids, sizes, held, n, made = [], [], [], 0, made + 1
            row["ids"] = row["ids"].cast(pa.list_(row["ids"].type.value_type))
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for b in batches:
            body, at = utf8(b.column(1))
            flags = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in spans(at, BYTES):
                k, before = with_ends(*word_keys(body[at[i] : at[j]], at[i : j + 1] - at[i]))
                keys.append(k)
                ids.append(b.column(0).slice(i, j - i))
                sizes.append(np.diff(before))
                held.append(flags[i:j])
                n += len(k)
                if n >= chunk:
                    yield flush()
        if n:
            yield flush()

    return src.mapInArrow(run, f"chunk long, n long, n_train long, begun long, keys binary, train binary, tokens binary, ids array<{kind}>, sizes binary, held binary")


def word_counts(found: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, counts, numbers, distinct): the training counts, over all chunks, and the numbers of a chunk's words of a word shard; distinct: once for a shard, its words learnt."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, k, t in zip(*(x.to_pylist() for x in b.columns), strict=True):
                keys, train = np.frombuffer(k, np.uint64), spread(t, np.uint32)
                part = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                own = [order[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                some = [p for p in range(parts) if len(own[p])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([keys[own[p]].tobytes() for p in some], pa.binary()), pa.array([squeeze(train[own[p]]) for p in some], pa.binary())],
                    names=["chunk", "part", "keys", "train"],
                )

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
        train = np.concatenate([spread(t, np.uint32) for t in table.column("train").to_pylist()])
        which, distinct = pd.factorize(np.concatenate(keys))
        total = np.bincount(which, weights=train, minlength=len(distinct)).astype(np.uint64)
        rank = np.empty(len(distinct), np.uint64)  # by key, so that a second run gives the same numbers
        rank[np.argsort(distinct)] = np.arange(len(distinct), dtype=np.uint64)
        number = rank * np.uint64(parts) + np.uint64(table.column("part")[0].as_py())
        ends = np.cumsum([len(k) for k in keys])
        own = [which[e - len(k) : e] for e, k in zip(ends, keys, strict=True)]
        once = np.zeros(len(keys), np.int64)
        once[0] = np.count_nonzero(total)
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "counts": pa.array([squeeze(total[w]) for w in own], pa.binary()), "numbers": pa.array([squeeze(number[w]) for w in own], pa.binary()), "distinct": pa.array(once)})

    asked = found.select("chunk", "keys", "train").mapInArrow(ask, "chunk long, part int, keys binary, train binary")
    return asked.groupBy("part").applyInArrow(answer, "chunk long, part int, counts binary, numbers binary, distinct long")


def chunk_table(found: DataFrame) -> DataFrame:
    """The chunks as a table bucketed by chunk, so that what is joined to them by chunk is all that is shuffled."""
    spark = found.sparkSession
    name = f"binomia_chunks_{uuid.uuid4().hex}"
    found.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("compression", "none").option("path", table_path(spark, "lm-chunks")).saveAsTable(name)
    return spark.table(name)


def classes(count: np.ndarray, limit: float) -> np.ndarray:
    """Over how many classes, by the word before, a preceding word's triples are dealt."""
    return np.maximum(1, np.ceil(count / limit)).astype(np.int64)


def numbered(row: dict, parts: int, begun: int) -> tuple[np.ndarray, np.ndarray]:
    """(training count over all chunks, number) of each word of a chunk and, at the end, of the begin token: the texts learnt from, and 0."""
    keys = np.frombuffer(row["keys"], np.uint64)
    count, number = np.zeros(len(keys) + 1, np.uint64), np.zeros(len(keys) + 1, np.uint64)
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for a in row["answers"]:
        own = order[cuts[a["part"]] : cuts[a["part"] + 1]]
        count[own], number[own] = spread(a["counts"], np.uint64), spread(a["numbers"], np.uint64) + np.uint64(1)
    count[-1] = begun
    return count, number


def pair_parts(number: np.ndarray, pair: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of a chunk's pairs, given as word * words + next word, by part; where each part starts, and the end)."""
    v, w = number[pair // len(number)], number[pair % len(number)]
    part = (mixed(mixed(v) + w) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def pair_counts(known: DataFrame, parts: int, limit: float, begun: int) -> DataFrame:
    """(chunk, part, totals, words, followers): of the pairs of a chunk that follow a word dealt over classes, those of a pair shard's, in
    order, the training counts over all chunks; once for a shard, such words and how many distinct words learnt of the shard follow each."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a batch may hold several chunks
                row = b.slice(i, 1).to_pylist()[0]
                release()
                count, number = numbered(row, parts, begun)
                n = len(number)
                token, size, held = spread(row["tokens"], np.uint32).astype(np.int32), spread(row["sizes"], np.uint32).astype(np.int64), spread(row["held"], np.uint8).astype(bool)
                near = np.empty(len(token), np.int32)
                near[1:], near[np.cumsum(size) - size] = token[:-1], n - 1
                own = np.flatnonzero((count > limit)[near])
                which, pair = pd.factorize(near[own].astype(np.int64) * n + token[own])
                del near, token
                train = np.bincount(which[~np.repeat(held, size)[own]], minlength=len(pair))
                order = np.argsort(pair)
                pair, train = pair[order], train[order]
                order, cuts = pair_parts(number, pair, parts)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[p] : cuts[p + 1]]
                    of = [squeeze(number[pair[own] // n]), squeeze(number[pair[own] % n]), squeeze(train[own].astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in of)], names=["chunk", "part", "v", "w", "train"])
                del which, own, pair, train, order, held, size
                release()

    def answer(table: pa.Table) -> pa.Table:
        v = [spread(x, np.uint64) for x in table.column("v").to_pylist()]
        ends = np.cumsum([len(x) for x in v])
        v, words = pd.factorize(np.concatenate(v))
        w, nexts = pd.factorize(np.concatenate([spread(x, np.uint64) for x in table.column("w").to_pylist()]))
        which, pair = pd.factorize(v * len(nexts) + w)
        del v, w
        total = np.bincount(which, weights=np.concatenate([spread(x, np.uint32) for x in table.column("train").to_pylist()]), minlength=len(pair)).astype(np.uint64)
        followers = np.bincount(pair[total > 0] // len(nexts), minlength=len(words))
        rows = len(ends)
        return pa.table({
            "chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([squeeze(total[which[i:j]]) for i, j in zip([0, *ends[:-1]], ends, strict=True)], pa.binary()),
            "words": pa.array([words.astype(np.int64).tolist(), *[None] * (rows - 1)], pa.list_(pa.int64())), "followers": pa.array([followers.tolist(), *[None] * (rows - 1)], pa.list_(pa.int64())),
        })

    asked = known.select("chunk", "keys", "tokens", "sizes", "held", "answers").mapInArrow(ask, "chunk long, part int, v binary, w binary, train binary")
    return asked.groupBy("part").applyInArrow(answer, "chunk long, part int, totals binary, words array<long>, followers array<long>")


def score(df: DataFrame, id_col: str, text_col: str, held_out: str, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; held_out: a boolean column, rows of which aren't learnt from."""
    found = chunk_table(chunks(df, id_col, text_col, held_out, chunk))
    total, learnt, begun = (x or 0 for x in found.agg(F.sum("n"), F.sum("n_train"), F.sum("begun")).first())
    parts, shards = max(1, -(-total // (4 * shard))) * 2, max(1, -(-total // shard))
    counts = written(word_counts(found, parts), "lm-words", "none")
    vocabulary = counts.agg(F.sum("distinct")).first()[0] or 0
    limit = max(1.0, total / shards / 4)
    whole = learnt + ADD * (vocabulary + 1)
    answers = counts.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "numbers")).alias("answers"))  # one a word shard
    known = found.select("chunk", "keys", "tokens", "ids", "sizes", "held").join(answers, "chunk")
    dealt, fans = shards > 1, np.zeros((0, 2), np.int64)
    if dealt:
        of_pairs = written(pair_counts(known, parts, limit, begun), "lm-pairs", "none")
        # words dealt over classes are at most four a shard
        by_word = of_pairs.where("words is not null").select(F.explode(F.arrays_zip("words", "followers")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.followers")).collect()
        fans = np.array(sorted(map(tuple, by_word)), np.int64).reshape(-1, 2)
        totals = of_pairs.groupBy("chunk").agg(F.collect_list(F.struct("part", "totals")).alias("totals"))  # one a pair shard
        known = known.join(totals, "chunk", "left")
    kind = df.schema[id_col].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a batch may hold several chunks
                row = b.slice(i, 1).to_pylist()[0]
                release()
                count, number = numbered(row, parts, begun)
                token, size, held = spread(row["tokens"], np.uint32).astype(np.int32), spread(row["sizes"], np.uint32).astype(np.int64), spread(row["held"], np.uint8).astype(bool)
                starts = np.cumsum(size) - size
                base = np.add.reduceat(np.log10((count + ADD) / whole)[token], starts)
                known = np.add.reduceat((count > 0)[token].astype(np.int64), starts)
                texts = {"ids": row["ids"], "held": held.tolist(), "n_tokens": size.tolist(), "n_known": known.tolist(), "base": base.tolist()}
                yield pa.RecordBatch.from_pylist([{"shard": row["chunk"] % shards, "chunk": row["chunk"], "blob": None, "texts": texts}], out_schema)
                n = len(number)  # the last one is the begin token
                doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
                near = np.empty(len(token), np.int32)
                near[1:], near[starts] = token[:-1], n - 1
                far = np.empty(len(token), np.int32)
                far[1:], far[starts] = near[:-1], n - 1
                pair, pairs = near.astype(np.int64), None
                pair *= n
                pair += far
                del near, far
                if n >= 1 << 21:  # three numbers don't fit into 63 bits
                    pair, pairs = pd.factorize(pair)
                pair *= n
                pair += token
                which, triple = pd.factorize(pair)  # by first place, which compresses best
                del pair, token
                which = which.astype(np.int32)
                train = np.bincount(which[~held[doc]], minlength=len(triple))
                both, w = triple // n, (triple % n).astype(np.int32)
                del triple
                both = both if pairs is None else pairs[both]
                v, u = (both // n).astype(np.int32), (both % n).astype(np.int32)
                del both, pairs
                release()  # a reused worker's heap keeps arrays of this size
                often = (count > limit)[v] if dealt else np.zeros(len(v), bool)
                whole_pair = np.zeros(len(v), np.uint64)
                if often.any():
                    distinct, at = np.unique(v[often].astype(np.int64) * n + w[often], return_inverse=True)
                    order, cuts = pair_parts(number, distinct, parts)
                    totals = np.empty(len(distinct), np.uint64)
                    for a in row["totals"]:
                        totals[order[cuts[a["part"]] : cuts[a["part"] + 1]]] = spread(a["totals"], np.uint64)
                    whole_pair[often] = totals[at]
                    del distinct, at, order, totals
                    release()
                split = classes(count.astype(float), limit)
                other = number[np.where(v == n - 1, w, u)]  # before a text's first word stands the begin token twice
                place = (mixed(mixed(number[v]) + mixed(other) % split[v].astype(np.uint64)) % np.uint64(shards)).astype(np.uint32 if shards >= 1 << 16 else np.uint16)
                del other
                by_shard = np.argsort(place, kind="stable")
                edge = np.searchsorted(place[by_shard], np.arange(shards + 1))
                token_place = place[which]
                tokens_of = np.argsort(token_place, kind="stable").astype(np.int32)
                token_edge = np.searchsorted(token_place[tokens_of], np.arange(shards + 1))
                del token_place
                inner = np.empty(len(place), np.int32)
                inner[by_shard] = np.arange(len(place), dtype=np.int32)
                for s in range(shards):
                    own = by_shard[edge[s] : edge[s + 1]]
                    if not len(own):
                        continue
                    here = np.zeros(n, bool)
                    for x in (v, u, w):
                        here[x[own]] = True
                    names, local = np.flatnonzero(here), np.cumsum(here, dtype=np.uint32) - np.uint32(1)
                    mine = tokens_of[token_edge[s] : token_edge[s + 1]]
                    of = inner[which[mine]] - edge[s]
                    ahead = np.maximum.accumulate(np.concatenate([[-1], of[:-1]])) + 1 - of  # 0 where a triple comes for the first time
                    many = own[often[own]]
                    of_pair = np.unique(v[many].astype(np.int64) * n + w[many], return_index=True)[1]  # in the order of local numbers too
                    d = doc[mine]
                    new = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                    blob = {"keys": squeeze(number[names]), "count": squeeze(count[names]), "v": squeeze(local[v[own]]), "u": squeeze(local[u[own]]), "w": squeeze(local[w[own]]), "train": squeeze(train[own].astype(np.uint32)), "whole": squeeze(whole_pair[many[of_pair]]), "ahead": squeeze(ahead.astype(np.uint32)), "doc": squeeze(np.diff(d[new], prepend=0).astype(np.uint32)), "runs": squeeze(np.diff(np.append(new, len(d))).astype(np.uint32))}
                    yield pa.RecordBatch.from_pylist([{"shard": s, "chunk": row["chunk"], "blob": blob, "texts": None}], out_schema)
                del v, u, w, which, train, often, whole_pair, place, by_shard, tokens_of, inner, doc
                release()

    fields = ("keys", "count", "v", "u", "w", "train", "whole", "ahead", "doc", "runs")
    ids = found.schema["ids"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    text_fields = [("ids", to_arrow_type(ids)), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64()))]
    out_schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("blob", pa.struct([(f, pa.binary()) for f in fields])), ("texts", pa.struct(text_fields))])
    texts_ddl = f"struct<ids:array<{kind}>,held:array<boolean>,n_tokens:array<bigint>,n_known:array<bigint>,base:array<double>>"
    blob_ddl = "struct<" + ",".join(f"{f}:binary" for f in fields) + ">"
    asked = known.mapInArrow(ask, f"shard long, chunk long, blob {blob_ddl}, texts {texts_ddl}")

    def answer(table: pa.Table) -> pa.Table:
        """Scores of one shard: of each chunk that sent a blob, (text, sum) pairs."""
        release()
        chunk, texts = table.column("chunk").to_pylist(), table.column("texts")
        have = np.flatnonzero(table.column("blob").is_valid().to_numpy()).tolist()
        column = {f: pc.struct_field(table.column("blob"), f) for f in fields}
        blob = lambda i, f, kind=np.uint32: spread(column[f][i].as_buffer(), kind)
        place, value = [None] * len(chunk), [None] * len(chunk)
        if have:
            keys = [blob(i, "keys", np.uint64) for i in have]
            which, names = pd.factorize(np.concatenate(keys))
            seen = np.zeros(len(names), np.uint64)
            seen[which] = np.concatenate([blob(i, "count", np.uint64) for i in have])
            ends = np.cumsum([len(k) for k in keys])
            part = {}
            for f in "vuw":
                part[f] = np.concatenate([which[e - len(k) : e][blob(i, f)] for i, k, e in zip(have, keys, ends, strict=True)])
            often = seen > limit if dealt else np.zeros(len(seen), bool)
            whole_pair = np.zeros(len(part["v"]), np.uint32 if learnt < 1 << 32 else np.uint64)
            at = 0
            for i, k, e in zip(have, keys, ends, strict=True):
                local_v, local_w = blob(i, "v"), blob(i, "w")
                many = np.flatnonzero(often[which[e - len(k) : e][local_v]])
                if len(many):
                    each = np.unique(local_v[many].astype(np.int64) * len(k) + local_w[many], return_inverse=True)[1]
                    whole_pair[at + many] = blob(i, "whole", np.uint64)[each]
                at += len(local_v)
            del which, keys
            train = np.concatenate([blob(i, "train") for i in have])
            n = len(names)
            code, roots = pd.factorize(part.pop("v"))  # numbers in use, in order
            rank = np.empty(len(roots), np.int64)
            rank[np.argsort(roots)] = np.arange(len(roots))
            root, roots = rank[code], np.sort(roots)
            del code
            pair = root * n + part.pop("u")
            pairs = None
            if len(roots) * n * n >= 1 << 63:
                pairs, pair = np.unique(pair, return_inverse=True)
            triple, of = np.unique(pair * n + part.pop("w"), return_inverse=True)
            del root, pair
            train = np.bincount(of, weights=train, minlength=len(triple)).astype(np.int64)
            given = np.zeros(len(triple), whole_pair.dtype)
            given[of] = whole_pair
            del whole_pair
            both, w = triple // n, (triple % n).astype(np.int32)
            del triple
            both = both if pairs is None else pairs[both]
            r, u = (both // n).astype(np.int32), (both % n).astype(np.int32)
            del both, pairs
            of = of.astype(np.int32)
            release()
            # counts of pairs, roots and followers: a word's own, all here, or those of all shards
            which, distinct = pd.factorize(r.astype(np.int64) * n + w)
            here = np.bincount(which, weights=train, minlength=len(distinct)).astype(np.int64)
            pair_total = here[which]
            own = often[roots][r]
            pair_total[own] = given[own]
            root_total = np.bincount(r, weights=train, minlength=len(roots)).astype(np.int64)
            followers = np.bincount((distinct // n)[here > 0], minlength=len(roots))
            del which, distinct, here, given
            many = np.flatnonzero(often[roots])
            root_total[many] = seen[roots[many]]
            followers[many] = fans[np.searchsorted(fans[:, 0], names[roots[many]].astype(np.int64)), 1]
            own = pair_total > 0
            release()
            p1 = (seen + ADD) / whole
            pair_total, train = pair_total[own], train[own]
            first = np.flatnonzero(names[roots] == 0)  # the begin token
            trie = Trie.mapped(build(r[own], u[own], w[own], train, p1, (pair_total, root_total, followers), int(first[0]) if len(first) else None))
            del pair_total, train, own
            release()
            scores = np.concatenate([trie.score(*(x[k : k + (1 << 19)].astype(np.int64) for x in (r, u, w))) for k in range(0, len(r), 1 << 19)])
            del r, u, w, trie
            at = 0
            for i in have:
                m = len(blob(i, "train"))
                own = scores[of[at : at + m]]
                at += m
                back = blob(i, "ahead").astype(np.int64)
                new = np.cumsum(back == 0) - 1  # the newest triple so far
                token = np.where(back == 0, new, new + 1 - back)
                runs = blob(i, "runs").astype(np.int64)
                place[i] = squeeze(np.cumsum(blob(i, "doc")).astype(np.uint32))
                value[i] = np.add.reduceat(own[token], np.cumsum(runs) - runs).tobytes()
            del scores, of
            release()
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "place": pa.array(place, pa.binary()), "value": pa.array(value, pa.binary()), "texts": texts})

    def finish(table: pa.Table) -> pa.Table:
        texts = next(t for t in table.column("texts").to_pylist() if t is not None)
        sums = np.zeros(len(texts["ids"]))
        for p, v in sorted((p, v) for p, v in zip(table.column("place").to_pylist(), table.column("value").to_pylist(), strict=True) if p is not None):
            sums[spread(p, np.uint32)] += np.frombuffer(v)
        n = len(sums)
        return pa.table({"id": pa.array(texts["ids"], to_arrow_type(ids.elementType)), "held_out": pa.array(texts["held"], pa.bool_()), "n_tokens": pa.array(texts["n_tokens"], pa.int64()), "n_known": pa.array(texts["n_known"], pa.int64()), "train_tokens": pa.array([learnt] * n, pa.int64()), "base_score": pa.array(texts["base"], pa.float64()), "score": pa.array(sums)})

    answered = asked.groupBy("shard").applyInArrow(answer, f"chunk long, place binary, value binary, texts {texts_ddl}")
    out = answered.groupBy("chunk").applyInArrow(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
