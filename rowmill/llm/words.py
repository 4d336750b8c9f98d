"""Words of a text as numpy arrays: bounds, 64-bit hashes and rolling n-gram hashes.

A word is ``[^\\x20\\x09-\\x0D]+``. All of these bytes are ASCII, so words can be cut from UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; the table grows when a longer word comes."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in an array of bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    change = np.diff(word)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """One 64-bit hash per word; ``fold`` treats A-Z as a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = np.cumsum(length)
    first = total - length
    within = np.arange(int(total[-1])) - np.repeat(first, length)
    letters = data[within + np.repeat(start, length)]
    table = powers(int(length.max()))
    values = (_BYTE_FOLDED if fold else _BYTE)[letters] * table[within]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + words[i : i + size]
    return mix(out)


def repeated(grams: np.ndarray) -> np.ndarray:
    """Whether each hash occurs twice or more, the first occurrence included."""
    if not len(grams):
        return np.zeros(0, bool)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(grams), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(grams), bool)
    out[order] = twice
    return out


def seen_before(grams: np.ndarray) -> np.ndarray:
    """Whether each hash occurs at an earlier place."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    out = np.zeros(len(grams), bool)
    out[order[1:]] = ranked[1:] == ranked[:-1]
    return out


def covered(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Positions among ``size`` that lie in a window of ``n`` starting at a hit."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(hits)
    edge[at] += 1
    np.subtract.at(edge, at + n, 1)
    return np.cumsum(edge[:-1]) > 0
