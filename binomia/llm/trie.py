"""An n-gram trie of order 3 in Elias-Fano levels, for contexts read nearest word first.

A root is a context word. Below it stand its following words
with quantised smoothed probabilities, and its preceding words, each with a quantised back-off weight and the
words that follow that longer context. Those are not stored as word numbers but relative to the root: as
positions among the root's following words, so that their numbers are small. All sequences are
Elias-Fano coded: pointers are monotone as they are, and each node's words are shifted by the last value of the
node before, which makes a level monotone. A word is found by a successor search within its node.

Probabilities are interpolated (Witten-Bell): the weight of a context's own counts against the shorter context
is its count against its number of distinct followers. The trie is one block of bytes that can be written to a
file and mapped into memory.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

BITS = 14


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of width bits each, in 64-bit words, with one word to spare."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, np.uint64)
    if width and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = values.astype(np.uint64)
        low = v << shift
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.bitwise_or.reduceat(low, first)
        over = shift + np.uint64(width) > 64
        if over.any():
            out[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
    return out


def _unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.int64)
    at = i.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    v = words[word] >> shift
    v |= np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (v & np.uint64((1 << width) - 1)).astype(np.int64)


class EliasFano:
    """A monotone sequence: the low bits of each value packed, the high ones in unary, each bucket closed by a zero."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, width: int) -> None:
        self.low, self.high, self.n, self.width = low, high, n, width
        self._directory: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def build(values: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.int64)
        upper = v >> width
        bits = np.zeros(n + (int(upper[-1]) if n else 0) + 1, np.uint8)
        bits[upper + np.arange(n)] = 1
        return {"low": _pack(v & ((1 << width) - 1), width), "high": np.packbits(bits)}, {"n": n, "width": width, "bits": len(bits)}

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        a, m = cls.build(values)
        return cls(a["low"], a["high"], m["n"], m["width"])

    def _dir(self) -> tuple[np.ndarray, np.ndarray]:
        """Decoded once for a batch of searches: the bucket of each value, and where each bucket starts."""
        if self._directory is None:
            bits = np.unpackbits(self.high)
            ones = np.flatnonzero(bits)[: self.n]
            upper = (ones - np.arange(len(ones))).astype(np.int32)
            buckets = int(upper[-1]) + 1 if self.n else 0
            starts = np.zeros(buckets + 1, np.int32)
            np.cumsum(np.bincount(upper, minlength=buckets), out=starts[1:])
            self._directory = upper, starts
        return self._directory

    def access(self, i: np.ndarray) -> np.ndarray:
        upper, _ = self._dir()
        return (upper[i].astype(np.int64) << self.width) | _unpack(self.low, self.width, i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Where the first value not under x is; n if there is none."""
        _, starts = self._dir()
        buckets = len(starts) - 1
        h = x >> self.width
        beyond = h >= buckets
        h = np.minimum(h, max(buckets - 1, 0))
        if not buckets:
            return np.zeros(len(x), np.int64)
        lo, hi = starts[h].astype(np.int64), starts[h + 1].astype(np.int64)
        lo[beyond] = hi[beyond] = self.n
        want = x & ((1 << self.width) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            under = _unpack(self.low, self.width, mid) < want[live]
            lo[live[under]] = mid[under] + 1
            hi[live[~under]] = mid[~under]
            live = live[lo[live] < hi[live]]
        return lo


class Level:
    """The children of nodes: pointers, and each node's values shifted by the last one of the nodes before."""

    def __init__(self, pointers: EliasFano, values: EliasFano) -> None:
        self.pointers, self.values = pointers, values

    @staticmethod
    def shifted(node: np.ndarray, value: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """(pointers, monotone values) of children sorted by (node, value)."""
        sizes = np.bincount(node, minlength=nodes)
        pointers = np.concatenate([[0], np.cumsum(sizes)])
        full = np.flatnonzero(sizes)
        last = value[pointers[full + 1] - 1] + 1
        base = np.zeros(nodes, np.int64)
        base[full] = np.cumsum(last) - last
        return pointers, value + base[node]

    def find(self, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the level, whether there) of each value below its node."""
        start, stop = self.pointers.access(node), self.pointers.access(node + 1)
        base = np.where(start > 0, self.values.access(np.maximum(start - 1, 0)) + 1, 0) if self.values.n else np.zeros(len(start), np.int64)
        at = self.values.successor(value + base)
        found = (at >= start) & (at < stop)
        got = np.minimum(at, max(self.values.n - 1, 0))
        if self.values.n:
            found &= self.values.access(got) == value + base
        return got, found


def quantise(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, code book): bins of at most a few values and of at most a width, each standing for its mean."""
    if not len(values):
        return np.zeros(0, np.uint16), np.zeros(1)
    low, high = float(values.min()), float(values.max())
    fine = 1 << 18
    grid = np.minimum(((values - low) * (fine / max(high - low, 1e-300))).astype(np.int64), fine - 1)
    held = np.bincount(grid, minlength=fine)
    total = np.bincount(grid, weights=values, minlength=fine)
    before = np.cumsum(held) - held
    share = (1 << bits) // 4  # bins of equal mass, of equal width, and two for each heavy value: a quarter each, two for the last
    size = -(-len(values) // share)
    used = np.flatnonzero(held)
    heavy = held[used] >= size  # a value of many has a bin of its own
    mass, place = before[used] // size, used // (fine // share)
    new = np.zeros(fine, bool)
    new[used] = np.concatenate([[True], (mass[1:] != mass[:-1]) | (place[1:] != place[:-1]) | heavy[1:] | heavy[:-1]])
    code_of = np.cumsum(new) - 1
    code_of = np.minimum(np.maximum(code_of, 0), (1 << bits) - 1)
    n = np.bincount(code_of, weights=held, minlength=1 << bits)
    book = np.bincount(code_of, weights=total, minlength=1 << bits) / np.maximum(n, 1)
    return code_of[grid].astype(np.uint16), book


def build(root: np.ndarray, before: np.ndarray, word: np.ndarray, count: np.ndarray, p1: np.ndarray, whole: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, sole: int | None = None) -> bytes:
    """The trie of counted (root, preceding word, word) triples, each given once, in order; p1: the probability of each word by number.

    whole: where a root's triples are in several tries, the count of each triple's (root, word) over all of them, above 0, and
    by root number the count and the number of distinct followers, 0 for no root; a triple without a count then stands for its pair.
    sole: with whole, a root that has one preceding word, whose counts are the root's over all tries."""
    words = len(p1)
    pairs, first, pair = np.unique(root.astype(np.int64) * words + word, return_index=True, return_inverse=True)
    if whole is None:
        roots = root[np.append(True, root[1:] != root[:-1])[: len(root)]]
        pair_root, pair_word = np.searchsorted(roots, pairs // words), pairs % words
        pair_count = np.bincount(pair, weights=count, minlength=len(pairs))
        root_count = np.bincount(pair_root, weights=pair_count, minlength=len(roots))
        followers = np.bincount(pair_root, minlength=len(roots))
    else:
        roots = np.flatnonzero(whole[1])
        pair_root, pair_word = np.searchsorted(roots, pairs // words), pairs % words
        pair_count, root_count, followers = whole[0][first], whole[1][roots], whole[2][roots]
        counted = count > 0
        root, before, count, pair = root[counted], before[counted], count[counted], pair[counted]
    pair = pair.astype(np.int32)
    del first, pairs
    r = np.searchsorted(roots, root)
    root_followers, root_weight = followers, followers / (root_count + followers)
    p2 = (pair_count + followers[pair_root] * p1[pair_word]) / (root_count + followers)[pair_root]
    pair_at, pair_values = Level.shifted(pair_root, pair_word, len(roots))
    change = np.append(True, (root[1:] != root[:-1]) | (before[1:] != before[:-1]))[: len(root)]
    c = np.cumsum(change) - 1
    context_root = r[change]
    context_count = np.bincount(c, weights=count, minlength=len(context_root))
    followers = np.bincount(c, minlength=len(context_root))
    if whole is not None and sole is not None:
        own = np.flatnonzero(roots[context_root] == sole)
        context_count[own], followers[own] = root_count[context_root[own]], root_followers[context_root[own]]
    weight = followers / (context_count + followers)
    context_at, context_values = Level.shifted(context_root, before[change], len(roots))
    p3 = (count + followers[c] * p2[pair]) / (context_count + followers)[c]
    place = pair - pair_at[context_root[c]]
    triple_at, triple_values = Level.shifted(c, place, len(context_root))
    arrays: dict[str, np.ndarray] = {}
    meta: dict[str, dict] = {}
    for name, values in (("roots", roots), ("pair_at", pair_at), ("pairs", pair_values), ("context_at", context_at), ("contexts", context_values), ("triple_at", triple_at), ("triples", triple_values)):
        a, m = EliasFano.build(values)
        arrays |= {f"{name}.{k}": v for k, v in a.items()}
        meta[name] = m
    for name, p in (("p1", p1), ("root_weight", root_weight), ("weight", weight), ("p2", p2), ("p3", p3)):
        arrays[f"{name}.codes"], arrays[f"{name}.book"] = quantise(np.log10(p))
    body, places = bytearray(), {}
    for k, v in arrays.items():
        body += b"\0" * (-len(body) % 8)
        places[k] = (len(body), v.dtype.str, len(v))
        body += v.tobytes()
    head = json.dumps({"levels": meta, "places": places}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + bytes(body)


class Trie:
    """A trie's levels as views of one block of bytes."""

    def __init__(self, block) -> None:
        n = int.from_bytes(block[:8], "little")
        head = json.loads(bytes(block[8 : 8 + n]))
        self.array = {k: np.frombuffer(block, kind, size, 8 + n + at) for k, (at, kind, size) in head["places"].items()}
        ef = {k: EliasFano(self.array[f"{k}.low"], self.array[f"{k}.high"], m["n"], m["width"]) for k, m in head["levels"].items()}
        self.roots = ef["roots"]
        self.pairs, self.contexts, self.triples = Level(ef["pair_at"], ef["pairs"]), Level(ef["context_at"], ef["contexts"]), Level(ef["triple_at"], ef["triples"])

    @classmethod
    def mapped(cls, block: bytes) -> Trie:
        """In memory mapped for it alone, outside Python's heap and given back as a whole."""
        held = mmap.mmap(-1, max(1, len(block)))
        held.write(block)
        return cls(memoryview(held))

    @classmethod
    def open(cls, path: str) -> Trie:
        """Of a file that holds a block, mapped into memory."""
        with open(path, "rb") as f:
            return cls(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))

    def _value(self, name: str, i: np.ndarray) -> np.ndarray:
        return self.array[f"{name}.book"][self.array[f"{name}.codes"][i]]

    def score(self, root: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each word after the root's word and the one before that."""
        out = self._value("p1", word)
        if not self.roots.n:
            return out
        r = np.minimum(self.roots.successor(root), self.roots.n - 1)
        live = np.flatnonzero(self.roots.access(r) == root)
        r = r[live]
        at, paired = self.pairs.find(r, word[live])
        out[live] += self._value("root_weight", r)
        out[live[paired]] = self._value("p2", at[paired])
        c, there = self.contexts.find(r, before[live])
        out[live[there]] += self._value("weight", c[there])
        both = np.flatnonzero(there & paired)
        place = at[both] - self.pairs.pointers.access(r[both])
        t, found = self.triples.find(c[both], place)
        out[live[both[found]]] = self._value("p3", t[found])
        return out
