"""Ranks of suffixes by the difference-cover algorithm."""

from __future__ import annotations

import numpy as np


#: Keys below this are named by a table in place of a sort.
TABLE = 1 << 25


def names(parts: list[np.ndarray]) -> np.ndarray:
    """Dense names from 1 on, in the order of the tuples that stand in ``parts`` side by side."""
    key = parts[0]
    for part in parts[1:]:
        width = int(part.max(initial=0)) + 1
        if int(key.max(initial=0)) > ((1 << 62) - 1) // width:
            key = dense(key)
        key = key * width + part
    if int(key.max(initial=0)) < max(TABLE, 2 * len(key)):
        there = np.zeros(int(key.max(initial=0)) + 1, bool)
        there[key] = True
        return np.cumsum(there)[key]
    return dense(key) + 1


def dense(key: np.ndarray) -> np.ndarray:
    """The place of each number among the distinct ones."""
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate((np.zeros(1, bool), ordered[1:] != ordered[:-1]))) if len(key) else 0
    return out


def joint(high: list[np.ndarray], low: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers that order pairs of (high, low), also across the arrays."""
    width = max(int(x.max(initial=0)) for x in low) + 1
    if max(int(x.max(initial=0)) for x in high) > ((1 << 62) - 1) // width:
        ends = np.cumsum([len(x) for x in high])[:-1]
        high = np.split(dense(np.concatenate(high)), ends)
    return [h * width + x for h, x in zip(high, low, strict=True)]


def suffix_ranks(symbols: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Ranks from 1 on of the suffixes at the ``wanted`` places (a mask; without one, of all); suffixes that differ within ``depth`` symbols are in their order.

    Symbols are 0 or more.  Suffixes at places that 3 does not divide are the
    sample: their triples are sorted and named, and the names, one class of
    places after the other, are ranked by recursion, which ends where names
    are distinct or reach ``depth``.  The remaining suffixes are sorted by
    their first symbol and the rank after it, and merged with the sample.
    Past the end of ``symbols`` stand zeros; suffixes that reach it within
    ``depth`` symbols are in some order.  Ranks of other places are 0.
    """
    n = len(symbols)
    if n < 3:
        order = sorted(range(n), key=lambda k: symbols[k:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(1, n + 1)
        return out
    s = np.concatenate((symbols.astype(np.int64), np.zeros(4, np.int64)))
    one, two, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((one, two))
    named = names([s[sample], s[sample + 1], s[sample + 2]])
    if depth > 3 and int(named.max()) < len(sample):
        deeper = suffix_ranks(np.concatenate((named[: len(one)], np.zeros(1, np.int64), named[len(one) :])), -(-depth // 3), None if wanted is None else _asked(wanted, one, two))
        named = np.concatenate((deeper[: len(one)], deeper[len(one) + 1 :]))
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = named
    if wanted is not None:
        sample, rest = sample[wanted[sample]], rest[wanted[rest]]
    sample = sample[np.argsort(rank[sample])]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    # against class 1: a symbol and the rank after it; against class 2: two symbols and the rank after them
    mine, theirs = joint([s[rest], s[one]], [rank[rest + 1], rank[one + 1]])
    by = np.argsort(mine)
    rest, mine = rest[by], mine[by]
    before = np.searchsorted(np.maximum.accumulate(theirs), mine)
    pairs = joint([s[rest], s[two]], [s[rest + 1], s[two + 1]])
    mine, theirs = joint(pairs, [rank[rest + 2], rank[two + 2]])
    before = np.maximum.accumulate(before + np.searchsorted(np.maximum.accumulate(theirs), mine)) if len(two) else before
    out = np.zeros(n, np.int64)
    out[rest] = before + np.arange(1, len(rest) + 1)
    out[sample] = np.arange(1, len(sample) + 1) + np.searchsorted(before, np.arange(len(sample)), side="right")
    return out


def _asked(wanted: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which places of the names must be ranked, so that the wanted places can be: what the keys of each class read."""
    asked = np.zeros(len(wanted) + 2, bool)
    for kind, ahead in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
        for k in ahead:
            places = wanted[kind::3]
            asked[kind + k :: 3][: len(places)] |= places
    return np.concatenate((asked[one], np.zeros(1, bool), asked[two]))


def equal_to_last(text: np.ndarray, places: np.ndarray, length: int, rows: int = 1 << 17) -> np.ndarray:
    """Whether each place's ``length`` bytes equal those of the place before it in ``places``."""
    out = np.zeros(len(places), bool)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for low in range(1, len(places), rows):
        part = view[places[low - 1 : low + rows]]
        out[low : low + rows] = (part[1:] == part[:-1]).all(1)
    return out
