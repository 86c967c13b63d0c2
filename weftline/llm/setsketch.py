"""SetSketch: mergeable registers of exponentially spaced, truncated minima.

Every element of a set gives each of ``M`` registers an exponential variate, and a register keeps
``floor(1 - log_B(smallest variate))``, cut to 0..Q + 1. So a sketch takes one byte a register, sketches of two
sets merge to that of their union by the larger value at each place, and two registers agree the more often the more alike the
sets are: with probability of about log_B(1 + J (B - 1)) at Jaccard similarity J. Hence runs of registers serve as
locality-sensitive band keys, and the numbers of registers that are larger, smaller and equal give the likelihood of J.
"""

from __future__ import annotations

import numpy as np
import xxhash

B, A, Q = 1.2, 20.0, 254
BANDS, ROWS = 36, 7
M = BANDS * ROWS
CHUNK = 512
_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 1 << 31, (M, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, (M, 1), dtype=np.uint32)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """An invertible mix of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Distinct sorted 64-bit hashes of the word shingles of a UTF-8 text with A-Z lower-cased; all words of a shorter text are one."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
    h = mixed(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)))
    n = len(w) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(mixed(total))


def registers(own: np.ndarray) -> np.ndarray:
    """The M registers (uint8) of a set of 64-bit hashes."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(M, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), CHUNK):
        h = x[None, k : k + CHUNK] * _MUL
        h ^= _ADD
        np.minimum(least, h.min(axis=1), out=least)
    smallest = -np.log1p(-(least + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(smallest) / np.log(B)), 0, Q + 1).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(regs: np.ndarray) -> float:
    """An estimate of a set's size from its registers."""
    return float(M * (1 - 1 / B) / (A * np.log(B) * np.sum(B ** -regs.astype(float))))


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 24) -> np.ndarray:
    """Maximum-likelihood estimates of the Jaccard similarity of pairs of sets: registers (pairs, M) and set sizes."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, ln = (B - 1) / B, np.log(B)
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood is concave in J: halve by the sign of its derivative
        j = (low + high) / 2
        x, y = 1 - c * (u - v * j), 1 - c * (v - u * j)
        p, q = -np.log(x) / ln, -np.log(y) / ln
        dp, dq = -c * v / (x * ln), -c * u / (y * ln)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(larger > 0, larger * dp / p, 0) + np.where(smaller > 0, smaller * dq / q, 0) - np.where(equal > 0, equal * (dp + dq) / (1 - p - q), 0)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2
