"""A compressed FM-index over words: a wavelet matrix of the BWT, and backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence; a level of packed bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros(self.n // 64 * 64 + 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int32)))[:-1].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        #: Where the run of each symbol starts on the last level.
        self.base = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """How many set bits of the ``k``-th level stand before each place."""
        word = at >> 6
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """query, symbol: all symbols from ``least`` on and below ``most`` at the places from ``low`` on and below ``high``, for many rectangles at once."""
        query = np.flatnonzero((high > low) & (most > least))
        low, high, symbol = low[query], high[query], np.zeros(len(query), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, low), self._ones(k, high)
            low, high = (np.concatenate((x - n, self.zeros[k] + n)) for x, n in zip((low, high), ones, strict=True))
            query, symbol = np.concatenate((query, query)), np.concatenate((symbol, symbol | 1 << level))
            live = np.flatnonzero((high > low) & (symbol < most[query]) & (symbol + (1 << level) > least[query]))
            low, high, query, symbol = low[live], high[live], query[live], symbol[live]
        times = high - low
        return np.repeat(query, times), np.repeat(symbol, times)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._down(symbols, at) - self.base[symbols]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols or more, by doubling; ties by place."""
    rank, n, k = symbols.astype(np.int64), len(symbols), 1
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
        if n and step[-1] == n - 1:
            break
    return np.argsort(rank, kind="stable")


class FMIndex:
    """An index of texts laid end to end, each closed by symbol 0; patterns have at most ``depth`` symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int):
        self.suffixes = suffix_order(symbols, depth + 1)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=sigma))))
        self.bwt = WaveletMatrix(symbols[self.suffixes - 1], sigma)
        self.depth = depth

    def search(self, symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the ``length`` symbols before each end: the interval of suffixes they begin, and how far the search went.

        All patterns stand in the index.  A search stops where one suffix,
        its own, is left: the matching statistic at that end is then shorter
        than the pattern.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.suffixes), np.int64)
        reached = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(1, length + 1):
            c = symbols[ends[live] - k]
            ranks = self.bwt.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[c] + ranks[: len(c)], self.first[c] + ranks[len(c) :]
            more = high[live] - low[live] > 1
            live = live[more]
            reached[live] = k
            if not len(live):
                break
        return low, high, reached


def interval_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of each interval; intervals are equal or apart."""
    if not len(low):
        return np.zeros(0, values.dtype)
    starts, back = np.unique(low, return_inverse=True)
    stops = np.zeros(len(starts), np.int64)
    stops[back] = high
    edges = np.column_stack((starts, stops)).ravel()
    padded = np.append(values, np.iinfo(values.dtype).max)
    return np.minimum.reduceat(padded, edges)[::2][back]
