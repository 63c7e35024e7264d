"""Byte-level BPE ids of many texts: words cut by array operations, each distinct word encoded once.

The vocabulary file's pattern cuts a text into contractions, runs of letters, digits or other signs with at most
one space before, and white space. Here the cuts come from arrays of code point classes, words are keyed by a
64-bit hash, and only words not met before go through the `tokenizers` library. The table of words is bounded.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, DIGIT, BLANK = 0, 1, 2, 3
#: Code points of the White_Space property. Fixed values.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_P = 0x9E3779B97F4A7C15 | 5
_P_INV = pow(_P, -1, 1 << 64)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(WHITE)] = BLANK
    return out


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _P_INV)]
    return _powers[0][:n], _powers[1][:n]


def cut(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where words start, given code points and a flag for each text's first."""
    n = len(cp)
    kind = classes()[cp]
    first = doc_start.copy()
    first[1:] |= kind[1:] != kind[:-1]
    word = first.copy()
    after = np.flatnonzero(first[1:] & ~doc_start[1:] & (kind[1:] != BLANK) & (kind[:-1] == BLANK)) + 1
    word[after - 1] = True
    word[after[cp[after - 1] == 0x20]] = False
    # contractions
    at = np.flatnonzero((cp == 0x27) & word)
    if len(at):
        look = np.zeros((2, len(at)), np.uint32)
        for k in (1, 2):
            ok = at + k < n
            pos = np.minimum(at + k, n - 1)
            ok &= ~doc_start[pos]
            if k == 2:
                ok &= look[0] > 0
            look[k - 1] = np.where(ok, cp[pos], 0)
        one = np.isin(look[0], [ord(c) for c in "stmd"])
        pair = look[0].astype(np.uint64) << np.uint64(32) | look[1]
        two = np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
        for flag, size in ((one, 1), (two, 2)):
            own = at[flag]
            word[own + 1] = False
            rest = own + 1 + size
            rest = rest[rest < n]
            word[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(word)


class WordTable:
    """Ids of distinct words by hash, at most `limit` of them."""

    def __init__(self, tokenizer, limit: int = 1 << 20) -> None:
        self.tokenizer, self.limit = tokenizer, limit
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _add(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(hashes) > self.limit:
            self._clear()
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))])
        pos = np.searchsorted(self.hashes, hashes)
        self.hashes, self.starts, self.sizes = (np.insert(x, pos, y) for x, y in ((self.hashes, hashes), (self.starts, starts), (self.sizes, sizes)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, len(texts) + 1 offsets)."""
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(chars)])
        whole = "".join(texts)
        n = len(whole)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        doc_start = np.zeros(n, bool)
        doc_start[offsets[:-1][chars > 0]] = True
        begin = cut(cp, doc_start)
        end = np.append(begin[1:], n)
        up, down = powers(n + 1)
        mixed = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= up[:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        keys = (sums[end] - sums[begin]) * down[begin]
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        for _ in range(2):  # a second time if the table was emptied
            pos = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
            known = self.hashes[pos] == distinct if len(self.hashes) else np.zeros(len(distinct), bool)
            if known.all():
                break
            new = first[~known]
            self._add(distinct[~known], [whole[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
        pos = np.searchsorted(self.hashes, distinct)
        starts, sizes = self.starts[pos][which], self.sizes[pos][which]
        stop = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1])]
        at = np.concatenate([[0], stop])[np.searchsorted(begin, offsets)]
        return ids, at


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """This process's table for a vocabulary file."""
    if path not in _tables:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _tables[path] = WordTable(t)
    return _tables[path]
