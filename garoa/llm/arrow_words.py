"""Words of whole text columns as arrays: bounds, 64-bit hashes, shingles.

A word is ``[^\\x20\\x09-\\x0D]+``. UTF-8 never uses these bytes inside another
character, so words are found on bytes. All functions work on many rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x += _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


@dataclass
class Words:
    """Words of some rows: byte bounds, and the first word of each row (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of rows that lie one after the other in ``data``."""
    if lower:
        data = _LOWER[data]
    size = len(data)
    inside = ~_IS_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word, computed over about a megabyte at a time."""
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        stop = int(np.searchsorted(starts, starts[begin] + _CHUNK))
        low, high = starts[begin], ends[stop - 1]
        at = starts[begin:stop] - low
        span = np.diff(np.append(at, high - low))
        place = np.arange(high - low) - np.repeat(at, span)
        piece = words.data[low:high]
        value = _BYTE[piece] * powers(_BASE, int(span.max()))[place]
        value[_IS_SPACE[piece]] = 0
        out[begin:stop] = np.add.reduceat(value, at)
        begin = stop
    return mix(out + (ends - starts).astype(np.uint64) * _STEP)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, and the row of each.

    A row with fewer than k words has its whole sequence as one; a row without
    words has none.
    """
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - k + 1
    scale = powers(_BASE, k + 1)
    if n > 0:
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * scale[j]
        whole = np.arange(n) + k <= first[rows[:n] + 1]
        out, of = mix(total[whole]), rows[:n][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] += hashes[first[short[has]] + j] * scale[j]
        extra = mix(extra + counts[short].astype(np.uint64) * scale[k])
        out, of = np.append(out, extra), np.append(of, short)
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted inside it."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def sequence_hash(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of each row's whole word sequence."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    if len(hashes):
        base = mix(np.array([seed], np.uint64))[0] | np.uint64(1)
        place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
        value = mix(hashes ^ base) * powers(base, int(counts.max()))[place]
        full = counts > 0
        out[full] = np.add.reduceat(value, first[:-1][full])
    return mix(out + counts.astype(np.uint64) * _STEP)
