"""A compressed FM-index over sequences of numbers, searched many patterns at a time.

The Burrows-Wheeler transform of all sequences is kept in a wavelet matrix: one
packed bit vector per bit of the alphabet, with counts every 64 positions.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        words = -(-len(bits) // 64) + 1
        packed = np.zeros(words * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.zeros(words, np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, end: np.ndarray) -> np.ndarray:
        """How many bits are set before each position."""
        word, bit = end >> 6, (end & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol before any position, for arrays of symbols and positions."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((shift, Bits(bit), zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the symbol's occurrences before low and before high, inside its own block."""
        begin = np.zeros(len(symbol), np.int64)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            b, lo, hi = bits.ones(begin), bits.ones(low), bits.ones(high)
            begin = np.where(one, zeros + b, begin - b)
            low = np.where(one, zeros + lo, low - lo)
            high = np.where(one, zeros + hi, high - hi)
        return low - begin, high - begin


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        follow = np.zeros(len(text), np.int64)
        follow[:-step] = rank[step:] + 1
        key = rank * (len(text) + 2) + follow
        order = np.argsort(key, kind="stable")
        placed = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.append(False, placed[1:] != placed[:-1]))
        if rank[order[-1]] == len(text) - 1:
            break
        step *= 2
    return order


class RangeMinimum:
    """Least value of any range, from minima over spans of powers of two."""

    def __init__(self, values: np.ndarray):
        self.spans = [values]
        while 2 << (len(self.spans) - 1) <= len(values):
            last, half = self.spans[-1], 1 << (len(self.spans) - 1)
            self.spans.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over ``[low, high)``, which must not be empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.spans[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.spans[k][low[at]], self.spans[k][high[at] - (1 << int(k))])
        return out


class FMIndex:
    """Sequences laid end to end, each after a separator; ``age`` orders their positions.

    Patterns of up to ``depth`` symbols can be sought.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, age: np.ndarray, depth: int):
        """``symbols`` from 1 on; ``first`` the begin of each sequence and the end of the last."""
        counts = np.diff(first)
        at = np.arange(len(symbols)) + np.repeat(np.arange(len(counts)), counts) + 1
        text = np.zeros(len(symbols) + len(counts) + 1, np.int64)
        text[at] = symbols
        self.text, self.at = text, at
        order = suffix_order(text, depth)
        before = text[order - 1]
        top = int(text.max(initial=0))
        self.matrix = WaveletMatrix(before, max(1, top.bit_length()))
        self.less = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))
        ages = np.full(len(text), np.iinfo(age.dtype).max, age.dtype)
        ages[at] = age
        self.ages = ages
        self.oldest = RangeMinimum(ages[order])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the interval of the pattern with a symbol before it."""
        below, upto = self.matrix.rank(symbol, low, high)
        return self.less[symbol] + below, self.less[symbol] + upto

    def matches(self, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Maximal stretches of the sequences, of ``least`` symbols or more, that an older place repeats.

        ``first`` bounds the sequences. Each is read from its end: a pattern grows
        backward while its interval holds a place older than its own, which are
        its matching statistics; where it stops, every run of ``least`` symbols
        over that place is new, so the next pattern ends before the run. Returns
        begin and end, as positions in ``symbols``.
        """
        counts = np.diff(first)
        seq = np.flatnonzero(counts >= least)
        end, floor = first[seq + 1].copy(), first[seq]
        begins, ends = [], []
        while len(end):
            stop = self._grow(end, floor)
            long = end - stop >= least
            begins.append(stop[long])
            ends.append(end[long])
            end = np.minimum(stop + least - 1, end - 1)
            going = (stop > floor) & (end - floor >= least)
            end, floor = end[going], floor[going]
        if not begins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(begins), np.concatenate(ends)

    def _grow(self, end: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The least begin of a pattern that ends at ``end`` and that an older place repeats."""
        begin = end.copy()
        live = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), len(self.text), np.int64)
        while len(live):
            live = live[begin[live] > floor[live]]
            place = self.at[begin[live] - 1]
            lo, hi = self.extend(self.text[place], low[live], high[live])
            older = self.oldest.least(lo, hi) < self.ages[place]
            live, lo, hi = live[older], lo[older], hi[older]
            low[live], high[live] = lo, hi
            begin[live] -= 1
        return begin
