"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
_RNG = np.random.default_rng(20240817)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _PLACES, _BASE = _ODD(256), _ODD(SIZE + 1), int(_ODD(1)[0])
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]  # A-Z count as a-z
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, mod 2**64."""
    if len(_powers[0]) <= n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n + 1, 1 << 20), b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles.

    A word's hash is a difference of prefix sums of its bytes' numbers times powers of a base,
    moved to power 0; a shingle's is made from its words' hashes. A text of fewer words than a
    shingle has one hash, of all its words; one without words has none.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    powers, inverses = _upto(len(data))
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    start = np.flatnonzero(before & ~space)
    stop = np.flatnonzero(space & ~before)
    sums = np.zeros(len(data) + 1, np.uint64)
    value = _BYTES[data]
    value *= powers[: len(data)]
    np.cumsum(value, out=sums[1:])
    words = mixed((sums[stop] - sums[start]) * inverses[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], ends[:-1]]))
    last = np.append(first[1:], len(start))
    every = np.zeros(0, np.uint64)
    if len(words) >= size:
        every = words[: len(words) - size + 1] * _PLACES[0]
        for k in range(1, size):
            every += words[k : len(words) - size + 1 + k] * _PLACES[k]
        every = mixed(every)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif n:
            out.append(mixed((words[a:b] * _PLACES[:n]).sum(keepdims=True) + _PLACES[SIZE:] * np.array([n], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Whether the sets' Jaccard index is percent or more, exactly; an empty set is linked with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
