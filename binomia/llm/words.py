"""Words of UTF-8 texts as 64-bit keys, by array operations on whole batches.

A word is a run of bytes other than the six ASCII white-space bytes, with A-Z lower-cased. Its key is a
polynomial of its bytes, each by a fixed random number, modulo 2 ** 64, mixed; n distinct words collide
somewhere with a chance of about n ** 2 / 2 ** 60.
"""

from __future__ import annotations

import numpy as np

END, BOS = np.uint64(1), np.uint64(2)
_P = 0xD1342543DE82EF95 & ~7 | 3  # 3 modulo 8: powers differ by few factors of two
_P_INV = pow(_P, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(1)).integers(1 << 63, dtype=np.uint64) + np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _P_INV)]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads keys over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) of each word's bytes and the number of words before each text (and in all)."""
    n = len(body)
    word = ~_SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_keys(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word in turn, number of words before each text and in all)."""
    if len(body) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, stop, before = word_spans(body, offsets)
    up, down = _power(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTES[body] * up[: len(body)], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * down[start]), before


def with_ends(keys: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with an END after each text's words."""
    n = len(before) - 1
    out = np.empty(len(keys) + n, np.uint64)
    at = before[1:] + np.arange(n)
    own = np.ones(len(out), bool)
    own[at] = False
    out[own] = keys
    out[at] = END
    return out, before + np.arange(n + 1)
