"""Vectorised words and hashes over bounded slices of UTF-8 text."""

from __future__ import annotations

import numpy as np

#: odd multipliers of the rolling hashes (arbitrary fixed values)
BASE = 0x9E3779B97F4A7C15
GRAM = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def byte_table(lower: bool, separators: bytes) -> np.ndarray:
    """256 entries: 0 for a separator, else the byte, lower-cased in A-Z if asked."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[0x41:0x5B] += 0x20
    t[np.frombuffer(separators, np.uint8)] = 0
    return t


#: all but 0-9, a-z, A-Z and non-ASCII
ALNUM_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
ALNUM = byte_table(True, ALNUM_SEPARATORS)
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: for bytes.translate: lower case, separators to a blank
ALNUM_TRANSLATE = bytes(b if b else 0x20 for b in ALNUM.tolist())

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        m = max(n, 1 << 20)
        p = np.full(m, BASE, np.uint64)
        p[0] = 1
        q = np.full(m, pow(BASE, -1, 1 << 64), np.uint64)
        q[0] = 1
        _powers["p"], _powers["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def prefix_hash(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of value * BASE**i, inverse powers): any span hashes in O(1)."""
    p, q = _pow(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
    return s, q


def span_hash(s: np.ndarray, q: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows of a slice: (mapped bytes, starts, ends, first word of each row + total)."""
    mapped = table[data]
    inside = mapped != 0
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return mapped, z, z, np.zeros(len(offsets), np.int64)
    prev = np.zeros(n, bool)
    prev[1:] = inside[:-1]
    nxt = np.zeros(n, bool)
    nxt[:-1] = inside[1:]
    cut = offsets[1:-1]
    prev[cut[cut < n]] = False
    nxt[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(inside & ~prev)
    ends = np.flatnonzero(inside & ~nxt) + 1
    return mapped, starts, ends, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (n - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(GRAM) + h[j : j + n]
    return mix(g)
