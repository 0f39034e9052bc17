"""Word shingles of whole texts as sets of 64-bit numbers, worked out with array operations."""

from __future__ import annotations

import numpy as np

U = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: A random odd base with its inverse modulo 2**64, and a random number for each byte.
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_BYTE = np.random.default_rng(20240501).integers(0, 2**64, 256, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = (h + U(salt * 0x9E3779B97F4A7C15 % 2**64)) * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) in their order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words count as one run, none as no run."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, U(min(size, len(w))), np.uint64)
    for k in range(min(size, len(w))):
        h = mix(h * U(3) + w[k : k + n], k + 1)
    return np.unique(h)
