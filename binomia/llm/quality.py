"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Three faults - noise, repetition, toxic words - each have labellers that vote bad (1), good (0) or abstain (2). A labeller
looks at shares of signs, capitals and table bars, at repeated words, word pairs and lines, at a short word list, at word
beginnings that toxic labelled texts have far more often than others - two labellers, each taught by its own half of the
labelled texts -, or is a person's label. Votes are counted by pattern over all texts - at most 3 ** labellers patterns, whatever
the input - and EM on these counts estimates the prior and each labeller's accuracy, the person's too; the posterior of each
pattern is the label that trains the scorer, the first two faults together as junk, the third as toxic. Its features are the presence of
hashed words, word beginnings and endings, and shares of the text by steps, over the whole text. Only the scorer decides.

Two steps use a sample of a bounded size, by a hash of id and text: the word beginnings (`labelled_rows` labelled
texts) and the scorer's training (`train_rows` texts: a third each of those with a posterior of junk, of toxic, and the rest, or all of
them where they are fewer; the scorer's bias is set right for the shares taken). Counting votes and scoring cover every row.

Cases: a null or empty text has no features and the bias's score, and is kept; repeated rows count each in votes, and once in training; a null id has no
label; no labels at all leave the labellers by labels silent; an empty table gives an empty result. Columns come back
as they were; the names of the added ones are parameters' defaults and replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import release, spans, utf8, written
from binomia.llm.words import _BYTES, _power, mixed, word_spans

TASKS = ("junk", "toxic")
VOTES = 10
HALVES = 2
LEAST_TEXTS, RATIO = 3, 12
LONG = 200
BITS = 18
BYTES = 1 << 19
LABELLED_ROWS = 20_000
TRAIN_ROWS = 16_000
PART_ROWS = 8_000
STEMS = (5, 7)
ABSTAIN = 2
#: English insults of the toxic word list. Fixed values.
INSULTS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "trash", "scum", "loser", "clown")
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "#$%&*|!@<>{}[]=~^_+\\"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_BAR = np.zeros(256, bool)
_BAR[[ord("|"), ord("!")]] = True
_LAST = _SIGN.copy()
_LAST[[ord(c) for c in ".,;:?"]] = True
_ROTATE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch of texts and sums by which any stretch of bytes gets its key."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray) -> None:
        self.body, self.offsets = body, offsets
        self.start, self.stop, self.before = word_spans(body, offsets) if len(body) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
        up, self.down = _power(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTES[body] * up[: len(body)], out=self.sums[1:])

    def keys(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def per_text(self, x: np.ndarray) -> np.ndarray:
        """Sums of a value of each word by text."""
        total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
        return total[self.before[1:]] - total[self.before[:-1]]

    def per_text_bytes(self, flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag[self.body], dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def stem(self, size: int) -> np.ndarray:
        return self.keys(self.start, np.minimum(self.stop, self.start + size))

    def core(self) -> np.ndarray:
        """Keys of the words without signs at their end."""
        stop = self.stop.copy()
        for _ in range(4):
            more = stop > self.start + 1
            more[more] = _LAST[self.body[stop[more] - 1]]
            stop -= more
        return self.keys(self.start, stop)

    def signs(self) -> list[np.ndarray]:
        """What toxic words are known by: their beginnings, and the whole word without signs at its end."""
        return [*(self.stem(k) for k in STEMS), self.core()]

    def features(self) -> np.ndarray:
        """Four hashed features a word: the word without signs at its end, two beginnings, its ending."""
        end = self.keys(np.maximum(self.start, self.stop - 3), self.stop)
        return np.stack([_slot(k, i) for i, k in enumerate((self.core(), self.stem(STEMS[0]), self.stem(STEMS[1]), end))], 1)

    def text_features(self) -> np.ndarray:
        """Hashed features of whole texts: each share by steps."""
        shares = (*self.shares()[:3], *self.repetition())
        return np.stack([_slot(np.minimum(x * 20, 20).astype(np.uint64) * np.uint64(64) + np.uint64(i) << np.uint64(3), 9 + i) for i, x in enumerate(shares)], 1)

    def shares(self) -> tuple[np.ndarray, ...]:
        """Signs and capitals over bytes, words that end in a sign and bars or exclamation marks over words."""
        size, n = np.maximum(np.diff(self.offsets), 1), np.maximum(np.diff(self.before), 1)
        last = self.body[self.stop - 1] if len(self.stop) else np.zeros(0, np.uint8)
        return self.per_text_bytes(_SIGN) / size, self.per_text_bytes(_CAPITAL) / size, self.per_text(_SIGN[last]) / n, self.per_text_bytes(_BAR) / n

    def repetition(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words over words, distinct pairs of neighbours over pairs, words like the one before over words."""
        n = np.diff(self.before)
        text = np.repeat(np.arange(len(n)), n)
        key = self.keys(self.start, self.stop)
        same_text = text[1:] == text[:-1]
        pair = mixed(key[:-1] * _ROTATE + key[1:])[same_text]
        out = [_distinct(text, key, len(n)) / np.maximum(n, 1), _distinct(text[1:][same_text], pair, len(n)) / np.maximum(n - 1, 1)]
        again = np.append(False, same_text & (key[1:] == key[:-1]))[: len(key)]
        return out[0], np.where(n > 1, out[1], 1.0), self.per_text(again) / np.maximum(n, 1)


def _slot(key: np.ndarray, kind: int) -> np.ndarray:
    return (key * (_ROTATE + np.uint64(2 * kind)) >> np.uint64(64 - BITS)).astype(np.int32)


def _distinct(text: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many distinct keys each text has; keys come text by text."""
    both = np.unique(mixed(key ^ (text.astype(np.uint64) * _ROTATE)), return_index=True)[1]
    return np.bincount(text[both], minlength=n)


def _key_of(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.concatenate([[0], np.cumsum([len(w) for w in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), at)
    return np.sort(w.keys(at[:-1], at[1:]))


def _three(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, 1, np.where(good, 0, ABSTAIN)).astype(np.int8)


def votes(w: Words, stems: list[np.ndarray]) -> np.ndarray:
    """A row a text: four labellers of noise, three of repetition, three of toxic text. stems: sorted keys of toxic word beginnings, of each half."""
    n = np.diff(w.before)
    sign, capital, ends, bars = w.shares()
    distinct, pairs, again = w.repetition()
    signs = w.signs()
    hits = w.per_text(np.isin(signs[-1], _INSULT_KEYS))
    listed = np.unique(np.concatenate(stems)) if sum(map(len, stems)) else np.zeros(1, np.uint64)
    place = [np.minimum(np.searchsorted(listed, x), len(listed) - 1) for x in signs]
    found = [listed[k] == x for k, x in zip(place, signs, strict=True)]
    odd = []
    for own in stems:
        known = np.isin(listed, own)
        odd.append(w.per_text(np.logical_or.reduce([f & known[k] for f, k in zip(found, place, strict=True)])))
    some = n >= 10
    return np.stack(
        [
            _three(sign, some & (sign > 0.03), some & (sign < 0.015)),
            _three(capital, some & (capital > 0.3), some & (capital < 0.1)),
            _three(ends, some & (ends > 0.15), some & (ends < 0.05)),
            _three(bars, some & (bars > 0.15), some & (bars < 0.02)),
            _three(distinct, (n >= 40) & (distinct < 0.3), (n >= 40) & (distinct > 0.45)),
            _three(pairs, some & (pairs < 0.45), some & (pairs > 0.6)),
            _three(again, some & (again > 0.3), some & (again < 0.1)),
            _three(hits, hits >= 1, hits == 0),
            *(_three(x, x >= 2, x == 0) if len(own) else np.full(len(n), ABSTAIN, np.int8) for x, own in zip(odd, stems, strict=True)),
        ],
        1,
    ).reshape(-1, VOTES)


_INSULT_KEYS = _key_of(INSULTS)
#: Of each fault, its labellers' places among the votes and, last, the person's.
FAULTS = {"noise": (0, 1, 2, 3, 10), "repetition": (4, 5, 6, 10), "toxic": (7, 8, 9, 11)}
#: What is thought of a person before their labels are seen: how many of so many labels are bad, of good texts and of bad texts.
PERSON, PERSON_LABELS = (0.02, 0.85), 50


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of bad, table [labeller, class, vote], posterior of each pattern) by expectation-maximisation; starts at the share of bad votes."""
    n, m = patterns.shape
    bad, good = (patterns == 1).sum(1), (patterns == 0).sum(1)
    p = np.clip((bad + 0.05) / (bad + good + 0.5), 0.02, 0.98)
    p = np.where(bad > 0, np.maximum(p, 0.6), np.where(good > 0, 0.02, 0.1))
    prior, table = 0.1, np.zeros((m, 2, 3))
    if not n:
        return prior, table, p
    for _ in range(rounds):
        was = p
        prior = float(np.clip((counts * p).sum() / max(counts.sum(), 1), 1e-4, 0.6))
        for c, q in ((1, p), (0, 1 - p)):
            for j in range(m):
                before = (0.5, 0.5, 0.0) if j < m - 1 else (PERSON_LABELS * (1 - PERSON[c]), PERSON_LABELS * PERSON[c], 0.0)  # the last is the person
                table[j, c] = np.bincount(patterns[:, j], weights=counts * q, minlength=3) + before
                table[j, c] /= table[j, c, :2].sum()
            table[:, c, ABSTAIN] = 1  # which says nothing
        score = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1][patterns[:, j]] / table[j, 0][patterns[:, j]]) for j in range(m))
        p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(p - was).max() < 1e-9:
            break
    return prior, table, p


def train(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 0.5, l1: float = 2e-3, seed: int = 1) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer by AdaGrad with an L1 penalty, the mean of the later epochs.

    target: probability of bad; a text counts as much as its label is sure. Features of fewer than LEAST_TEXTS texts stay out.
    """
    found = np.zeros(2**BITS, np.int64)
    for idx, _ in features:
        found[idx] += 1
    live = found >= LEAST_TEXTS
    rows = [(idx[live[idx]], held[live[idx]]) for idx, held in features]
    w, g, mean = np.zeros(2**BITS + 1), np.full(2**BITS + 1, 1e-2), np.zeros(2**BITS + 1)
    rng = np.random.Generator(np.random.PCG64(seed))
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            (idx, held), t = rows[i], target[i]
            step = 1 / (1 + np.exp(-np.clip((w[idx] * held).sum() + w[-1], -30, 30))) - t
            step *= abs(2 * t - 1)
            if abs(step) < 1e-3:  # a text that is known already
                continue
            d = step * held
            g[idx] += d * d
            size = rate / np.sqrt(g[idx])
            moved = w[idx] - size * d
            w[idx] = np.sign(moved) * np.maximum(np.abs(moved) - l1 * size, 0)
            g[-1] += step * step
            w[-1] -= 0.2 * step / np.sqrt(g[-1])
        if 2 * epoch >= epochs:
            mean += w / (epochs // 2)
    return mean


def _damped(words: np.ndarray) -> np.ndarray:
    """What a word feature counts in a text of so many words: less in long ones, which have more of any feature by chance."""
    return 1 / np.sqrt(np.maximum(1, words / LONG))


def _bag(f: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = np.unique(f.ravel())
    return np.append(idx, whole), np.append(np.full(len(idx), _damped(np.array(len(f)))), np.ones(len(whole)))


def linear(w: Words, weights: np.ndarray) -> np.ndarray:
    """Log-odds of bad of each text, a row a task; weights: a row a task. A feature counts once a text; most have no weight."""
    texts, damp = len(w.before) - 1, _damped(np.diff(w.before))
    slots, whole = w.features(), w.text_features()
    text = np.repeat(np.arange(texts, dtype=np.int64), np.diff(w.before))
    out = np.empty((len(weights), texts))
    for k, own in enumerate(weights):
        live = own[:-1] != 0
        at, kind = np.nonzero(live[slots])
        once = np.unique(text[at] << BITS | slots[at, kind])
        out[k] = np.bincount(once >> BITS, weights=own[:-1][once & ((1 << BITS) - 1)], minlength=texts) * damp + own[:-1][whole].sum(1) + own[-1]
    return out


def _sampled(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows by hash of id and text; the same ones each time."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(3), "id", F.coalesce("t", F.lit(""))), F.lit(1 << 40)) < int((1 << 40) * rows / n))


class Model:
    """stems by half, EM's results by fault, and the scorer's weights by task."""

    def __init__(self, stems: list[np.ndarray], tasks: dict, weights: np.ndarray) -> None:
        self.stems, self.tasks, self.weights = stems, tasks, weights


def toxic_stems(labelled: DataFrame) -> np.ndarray:
    """Keys of words and word beginnings that toxic texts have, by label, far more often than others. labelled: (t, toxic), of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = utf8(b.column(0))
            toxic = b.column(1).to_numpy(zero_copy_only=False)
            w = Words(body, at)
            text = np.repeat(np.arange(b.num_rows), np.diff(w.before))
            text, stem = np.tile(text, len(STEMS) + 1), np.concatenate(w.signs())
            order = np.lexsort((stem, text))
            t, k = text[order], stem[order]
            new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))[: len(t)]
            names, which = np.unique(k[new], return_inverse=True)
            bad = np.bincount(which, weights=toxic[t[new]] > 0, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(np.bincount(which, minlength=len(names)) - bad)], names=["stem", "bad", "good"])

    n_bad, n_good = labelled.agg(F.sum((F.col("toxic") > 0).cast("long")), F.sum((F.col("toxic") <= 0).cast("long"))).first()
    if not n_bad or not n_good:
        return np.zeros(0, np.uint64)
    sums = labelled.select("t", "toxic").mapInArrow(run, "stem long, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = (F.col("bad") / n_bad) / ((F.col("good") + 0.5) / n_good)
    rows = sums.where((F.col("bad") >= LEAST_TEXTS) & (ratio > RATIO)).select("stem").collect()  # of a bounded sample
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def fit(df: DataFrame, id_col: str, text_col: str, labels: DataFrame | None, label_id: str = "doc_id", labelled_rows: int = LABELLED_ROWS, train_rows: int = TRAIN_ROWS) -> Model:
    """labels: (label_id, quality, toxic) of some rows, or None."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    if labels is None:
        labels = spark.createDataFrame([], f"{label_id} {docs.schema['id'].dataType.simpleString()}, quality int, toxic int")
    known = labels.groupBy(F.col(label_id).alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("id is not null")
    few = _sampled(known.withColumn("t", F.lit("")), labelled_rows).drop("t")
    labelled = written(docs.join(F.broadcast(few), "id").select("t", "toxic", F.pmod(F.xxhash64(F.lit(5), "t"), F.lit(HALVES)).alias("half")).where("toxic is not null"), "labelled")  # few: labelled_rows rows at most
    stems = [toxic_stems(labelled.where(F.col("half") == h)) for h in range(HALVES)]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = utf8(b.column(1))
            for i, j in spans(at, BYTES):
                v = votes(Words(body[at[i] : at[j]], at[i : j + 1] - at[i]), stems)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array((v * 3 ** np.arange(v.shape[1])).sum(1).astype(np.int32))], names=["id", "key", "pattern"])
            release()

    kind = docs.schema["id"].dataType.simpleString()
    key = F.xxhash64(F.lit(3), "id", F.coalesce("t", F.lit("")))
    by_person = F.when(F.col("quality").isNull(), ABSTAIN).otherwise((F.col("quality") < 1).cast("int")), F.when(F.col("toxic").isNull(), ABSTAIN).otherwise((F.col("toxic") > 0).cast("int"))
    said = docs.withColumn("key", key).mapInArrow(vote, f"id {kind}, key long, pattern int").join(known, "id", "left")
    said = written(said.select("key", "pattern", by_person[0].alias("q"), by_person[1].alias("x")), "votes")
    counted = said.groupBy("pattern", "q", "x").agg(F.count("*").alias("n")).collect()  # 3 ** 12 at most
    pattern = np.array([[r[0] // 3**k % 3 for k in range(VOTES)] + [r[1], r[2]] for r in counted], np.int64).reshape(-1, VOTES + 2)
    counts = np.array([r[3] for r in counted], float)
    tasks = {}
    for task, columns in FAULTS.items():
        own, which = np.unique(pattern[:, columns], axis=0, return_inverse=True) if len(pattern) else (np.zeros((0, len(columns)), np.int64), np.zeros(0, np.int64))
        prior, table, p = estimate(own, np.bincount(which.ravel(), weights=counts, minlength=len(own)))
        tasks[task] = {"prior": prior, "table": table, "posterior": {tuple(r): float(x) for r, x in zip(own.tolist(), p, strict=True)}}

    def fit_part(table: pa.Table) -> pa.Table:
        features, target = [], {t: [] for t in TASKS}
        body, at = utf8(table.column("t"))
        person = np.stack([np.where(table.column(c).is_null().to_numpy(), ABSTAIN, f(table.column(c).fill_null(0).to_numpy())) for c, f in (("quality", lambda x: x < 1), ("toxic", lambda x: x > 0))], 1)
        for i, j in spans(at, BYTES):
            w = Words(body[at[i] : at[j]], at[i : j + 1] - at[i])
            f, whole = w.features(), w.text_features()
            features += [_bag(f[a:b], x) for a, b, x in zip(w.before, w.before[1:], whole, strict=False)]
            v = np.concatenate([votes(w, stems), person[i:j]], 1).astype(int)
            p = {fault: np.array([tasks[fault]["posterior"].get(tuple(r), 0.5) for r in v[:, columns].tolist()]) for fault, columns in FAULTS.items()}
            target["junk"] += (1 - (1 - p["noise"]) * (1 - p["repetition"])).tolist()
            target["toxic"] += p["toxic"].tolist()
        got = []
        for t in TASKS:
            weights = train(features, np.array(target[t]))
            weights[-1] += shift[t]
            got.append(weights.astype(np.float32).tobytes())
        del features, target
        release()
        return pa.table({"part": table.column("part").slice(0, 1), "junk": pa.array([got[0]], pa.binary()), "toxic": pa.array([got[1]], pa.binary())})

    # strata by posterior, and how much of each is taken
    p_of = {fault: np.array([tasks[fault]["posterior"][tuple(r)] for r in pattern[:, columns].tolist()]) for fault, columns in FAULTS.items()}
    bad = {"junk": 1 - (1 - p_of["noise"]) * (1 - p_of["repetition"]), "toxic": p_of["toxic"]}
    stratum = np.where(bad["toxic"] > 0.5, 2, np.where(bad["junk"] > 0.5, 1, 0))
    held = np.bincount(stratum, weights=counts, minlength=3)
    rate = np.minimum(1, train_rows / 3 / np.maximum(held, 1))
    rate[0] = min(1, (train_rows - (held * rate)[1:].sum()) / max(held[0], 1))
    shift = {}
    for t in TASKS:
        was, now = counts * bad[t], counts * (1 - bad[t])
        taken = [max((x * rate[stratum]).sum(), 1e-9) / max(x.sum(), 1e-9) for x in (was, now)]
        shift[t] = float(np.log(taken[1] / taken[0])) if len(counts) else 0.0
    cut = spark.createDataFrame([(*map(int, (r[0], r[1], r[2])), int((1 << 40) * rate[k])) for r, k in zip(counted, stratum, strict=True)], "pattern int, q int, x int, below long")  # 3 ** 12 at most
    chosen = said.join(F.broadcast(cut), ["pattern", "q", "x"]).where(F.pmod("key", F.lit(1 << 40)) < F.col("below")).select("key").distinct()  # about train_rows
    some = docs.withColumn("key", key).join(F.broadcast(chosen), "key").dropDuplicates(["key"]).join(known, "id", "left").withColumn("part", F.pmod("key", F.lit(max(1, -(-train_rows // PART_ROWS)) if counts.sum() > PART_ROWS * 2 else 1)).cast("int")).drop("key")
    fitted = some.groupBy("part").applyInArrow(fit_part, "part int, junk binary, toxic binary").collect()  # a row a part
    fitted.sort(key=lambda r: r[0])
    if not fitted:
        return Model(stems, tasks, np.zeros((2, 2**BITS + 1), np.float32))
    weights = np.stack([np.mean([np.frombuffer(r[t], np.float32) for r in fitted], axis=0) for t in TASKS])
    return Model(stems, tasks, weights)


def classify(df: DataFrame, text_col: str, model: Model, junk_at: float = 0.5, toxic_at: float = 0.95) -> DataFrame:
    """df with junk_score, toxic_score (probabilities) and keep; toxic_at: high, as clean texts should stay."""
    weights = df.sparkSession.sparkContext.broadcast(model.weights)  # 2 * (2 ** BITS + 1) numbers
    extra = ["junk_score", "toxic_score", "keep"]
    columns = [c for c in df.columns if c not in extra]
    src = df.select(*columns)
    k = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body, at = utf8(b.column(k))
            for i, j in spans(at, BYTES):
                w = Words(body[at[i] : at[j]], at[i : j + 1] - at[i])
                p = 1 / (1 + np.exp(-np.clip(linear(w, weights.value), -50, 50)))
                empty = np.diff(w.before) == 0
                keep = empty | ((p[0] < junk_at) & (p[1] < toxic_at))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns), pa.array(p[0]), pa.array(p[1]), pa.array(keep)], names=columns + extra)
            release()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{ddl}, junk_score double, toxic_score double, keep boolean")
