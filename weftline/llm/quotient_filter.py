"""Counting quotient filters that lose nothing: compact sorted multisets of packed keys.

A key is two numbers of fixed widths (left, right), as packed word ids are. A keyed mix, invertible as each step changes one number by the
other, spreads the keys evenly. The first bits of the mixed left number are a key's shard, the next its quotient, and *all* other bits its
remainder, so a key can be told from its place and remainder: nothing is approximate. A filter holds the keys of one shard in
order, as quotient runs in unary (a one per entry, a zero after each run: two bits an entry), the remainders in as few bytes as they
need, and counts of one byte, with an overflow list. Sorted filters of a shard merge by addition.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_ROUNDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _scramble(x: np.ndarray, key: np.uint64) -> np.ndarray:
    h = (x + key) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Layout:
    """Widths in bits of the left and the right number, and the bits of a shard number."""

    left: int
    right: int
    shard: int

    def permuted(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k, key in enumerate(_ROUNDS):
            if k % 2:
                right = right ^ (_scramble(left, key) & _mask(self.right))
            else:
                left = left ^ (_scramble(right, key) & _mask(self.left))
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k, key in reversed(list(enumerate(_ROUNDS))):
            if k % 2:
                right = right ^ (_scramble(left, key) & _mask(self.right))
            else:
                left = left ^ (_scramble(right, key) & _mask(self.left))
        return left, right

    def shards(self, left: np.ndarray) -> np.ndarray:
        return (left >> np.uint64(self.left - self.shard)).astype(np.int64)


def summed(layout: Layout, left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct mixed keys in order, with the sums of their counts (1 each if not given)."""
    if layout.left + layout.right <= 64:  # one number sorts faster than two
        both = (left << np.uint64(layout.right)) | right
        if counts is None:
            keys, n = np.unique(both, return_counts=True)
        else:
            order = np.argsort(both, kind="stable")
            both = both[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
            keys, n = both[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]
        return keys >> np.uint64(layout.right), keys & _mask(layout.right), n.astype(np.int64)
    counts = np.ones(len(left), np.int64) if counts is None else counts
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate(([True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])))) if len(left) else np.zeros(0, np.int64)
    return left[first], right[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def encode(layout: Layout, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter of distinct mixed keys in order, all of one shard."""
    n = len(left)
    quotient = min(max(0, n.bit_length() - 1), layout.left - layout.shard)
    low = layout.left - layout.shard - quotient
    q = ((left >> np.uint64(low)) & _mask(quotient)).astype(np.int64)
    runs = np.zeros(n + (1 << quotient), np.uint8)
    runs[np.arange(n) + q] = 1
    rest = [_bytes(left & _mask(low), low), _bytes(right, layout.right)]
    large = np.flatnonzero(counts > 254)
    short = np.where(counts > 254, 255, counts).astype(np.uint8)
    head = struct.pack("<qqq", n, quotient, len(large))
    return b"".join([head, np.packbits(runs).tobytes(), *(x.tobytes() for x in rest), short.tobytes(), counts[large].astype("<i8").tobytes()])


def decode(layout: Layout, shard: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mixed keys and counts of a filter."""
    n, quotient, n_large = struct.unpack_from("<qqq", data)
    low = layout.left - layout.shard - quotient
    at = struct.calcsize("<qqq")

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    total = n + (1 << quotient)
    q = np.flatnonzero(np.unpackbits(take(-(-total // 8)), count=total)) - np.arange(n)
    rest = _number(take(n * -(-low // 8)), n)
    right = _number(take(n * -(-layout.right // 8)), n)
    counts = take(n).astype(np.int64)
    counts[counts == 255] = take(8 * n_large).view("<i8")
    left = (np.uint64(shard) << np.uint64(layout.left - layout.shard)) | (q.astype(np.uint64) << np.uint64(low)) | rest
    return left, right, counts


def _bytes(x: np.ndarray, bits: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)])


def _number(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        part = data.reshape(n, -1)
        out[:, : part.shape[1]] = part
    return out.view("<u8").reshape(-1).astype(np.uint64)
