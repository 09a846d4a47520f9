"""Static 3-wise binary fuse filters over 64-bit keys, in numpy."""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<QIIQ"  # seed, segment, count, keys


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys ^ np.uint64(seed)
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots a key, in three consecutive segments."""
    first = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    parts = [(first + np.uint64(i)) * np.uint64(segment) + ((h >> np.uint64(18 * i)) & mask) for i in range(3)]
    return np.stack(parts).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter that holds all ``keys``; others pass once in 256 times.

    Peeling goes in rounds: every slot that only one key touches frees that
    key, all of them at once.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // segment) - 2)
    seed = 0x9E3779B97F4A7C15
    while True:
        h = _mix(keys, seed)
        slots = _slots(h, segment, count)
        size = (count + 2) * segment
        order = _peel(slots, n, size)
        if order is not None:
            break
        seed = (seed * 6364136223846793005 + 1442695040888963407) & (1 << 64) - 1
        count += count // 32 + 1
    table, prints = np.zeros(size, np.uint8), _print(h)
    for freed, own in reversed(order):
        table[own] = 0
        table[own] = prints[freed] ^ table[slots[0, freed]] ^ table[slots[1, freed]] ^ table[slots[2, freed]]
    return struct.pack(HEAD, seed, segment, count, n) + table.tobytes()


def _peel(slots: np.ndarray, n: int, size: int):
    degree, held = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in slots:
        np.add.at(degree, row, 1)
        np.bitwise_xor.at(held, row, np.arange(n))
    order, left = [], n
    ready = np.flatnonzero(degree == 1)
    while len(ready):
        freed, at = np.unique(held[ready], return_index=True)
        order.append((freed, ready[at]))
        left -= len(freed)
        touched = slots[:, freed]
        for row in touched:
            np.subtract.at(degree, row, 1)
            np.bitwise_xor.at(held, row, freed)
        around = np.unique(touched)
        ready = around[degree[around] == 1]
    return order if left == 0 else None


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, count, n = struct.unpack_from(HEAD, blob)
    if n == 0:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=struct.calcsize(HEAD))
    h = _mix(keys.astype(np.uint64), seed)
    a, b, c = _slots(h, segment, count)
    return (table[a] ^ table[b] ^ table[c]) == _print(h)
