"""Hashes of all words of a batch of texts at once, with numpy.

A word's hash is a polynomial over its bytes, from prefix sums over the batch, and doesn't depend on where it stands.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MOST = 64


def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


_VALUE = _byte_values()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters all bits (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD[_c] = True


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the end): words are runs of letters and digits, in lower case."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = _WORD[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = turn[::2], turn[1::2]
    power, inverse = _power(len(data) + 1)
    sums = np.cumsum(np.where(inside, _VALUE[data] * power[: len(data)], np.uint64(0)), dtype=np.uint64)
    hashes = mix((sums[end - 1] - sums[begin - 1]) * inverse[begin])
    starts = np.cumsum([1] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(begin, starts)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on (len(hashes) - n + 1 of them)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD1B54A32D192ED03) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)
