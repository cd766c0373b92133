"""Hashed word shingles of whole texts, vectorised over UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z are lower-cased; since the separators
are ASCII, splitting the UTF-8 bytes is the same as splitting the text. Word hashes are polynomial (mod 2**64,
over a random value for each byte) and then mixed; a shingle's hash mixes the hashes of its five words.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = np.random.default_rng(20240301).integers(1, 2**63 - 1, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse mod 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 1 << 17)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        base[0] = inverse[0] = 1
        _powers, _inverse = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers[:n], _inverse[:n]


def word_hashes(data: bytes) -> np.ndarray:
    """One uint64 for each word, in text order."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[a]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = powers(len(a) + 1)
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power[: len(a)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(data: bytes, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of all words as one shingle if there are fewer; empty without words."""
    w = word_hashes(data)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _PLACE[j % 64]
    h = np.sort(mix(h))
    return h[np.append(True, h[1:] != h[:-1])]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit identity of a set: equal sets have equal ids."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
