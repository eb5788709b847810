"""Benchmark items inside documents, by fingerprints of item-sized windows.

Every run of words as long as an item is a window. A window that shares fewer
shingles with the whole benchmark than the required likeness needs is passed
over, which loses nothing. Others get a 64-bit SimHash of their shingles, each
weighing as often as it occurs. An index over eight 8-bit blocks, each listed
with all values at most two bits away, finds every item of that length whose
fingerprint is within 23 bits: of 23 differing bits, some block has at most two.
Exact weighted likeness of the shingles then decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garoa.llm.arrow_words import Words, mix, powers, split_words, word_hashes
from garoa.llm.shared import arrow_batch, by_bytes, offsets_of, row_udf

SHINGLE = 5
LIKENESS = 0.75
BLOCKS = 8
NEAR = 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: Benchmark text a pass over the documents holds; a larger benchmark takes more passes.
PASS_BYTES = 8 << 20
_CHUNK_WORDS = 50_000
_BASE = np.uint64(0xA24BAED4963EE407)


def _grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the k words from each word on, and whether they lie in one row."""
    n, scale = len(hashes), powers(_BASE, k)
    total, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= k:
        for j in range(k):
            total[: n - k + 1] += hashes[j : n - k + 1 + j] * scale[j]
        ends = np.repeat(first[1:], np.diff(first))
        whole = np.arange(n) + k <= ends
    return mix(total + np.uint64(k)), whole


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 per bit of each hash."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return 2 * bits.astype(np.int32) - 1


def _pack(lanes: np.ndarray) -> np.ndarray:
    """Fingerprints whose bits say which lanes are above 0."""
    return np.packbits(lanes > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def _block(fingerprints: np.ndarray, b: int) -> np.ndarray:
    return ((fingerprints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)


@dataclass
class Index:
    """Benchmark items of one pass and their block index."""

    ids: list
    length: np.ndarray
    fingerprint: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    known: dict[int, np.ndarray]
    lists: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def build_index(items: list[tuple]) -> Index:
    """Index ``(item_id, text)`` pairs; items without words are left out."""
    column = pa.array([t or "" for _, t in items], pa.string())
    words = split_words(*offsets_of(column), lower=True)
    hashes = word_hashes(words)
    ids, lengths, prints, sets = [], [], [], []
    known: dict[int, list[np.ndarray]] = {}
    for row, (item_id, _) in enumerate(items):
        own = hashes[words.first[row] : words.first[row + 1]]
        if not len(own):
            continue
        k = min(SHINGLE, len(own))
        values = _grams(own, np.array([0, len(own)]), k)[0][: len(own) - k + 1]
        ids.append(item_id)
        lengths.append(len(own))
        prints.append(_pack(_signs(values).sum(0, keepdims=True))[0])
        sets.append(np.unique(values, return_counts=True))
        known.setdefault(k, []).append(values)
    length, fingerprint = np.array(lengths, np.int64), np.array(prints, np.uint64)
    lists = {}
    bits = np.array([bin(v).count("1") for v in range(256)])
    near = np.flatnonzero(bits <= NEAR)
    for size in np.unique(length):
        members = np.flatnonzero(length == size)
        for b in range(BLOCKS):
            values = (_block(fingerprint[members], b)[:, None] ^ near[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange(257))
            lists[int(size), b] = (starts, np.repeat(members, len(near))[order])
    return Index(ids, length, fingerprint, sets, {k: np.unique(np.concatenate(v)) for k, v in known.items()}, lists)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array; most are ruled out by their first bits."""
    table = np.zeros(1 << 20, bool)
    table[(known >> np.uint64(44)).astype(np.int64)] = True
    out = table[(values >> np.uint64(44)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, values[maybe]), len(known) - 1)
    out[maybe] = known[at] == values[maybe]
    return out


def _candidates(index: Index, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows and items within the radius, each pair once, and their distances."""
    windows, items = [], []
    for b in range(BLOCKS):
        starts, members = index.lists[size, b]
        value = _block(prints, b)
        count = starts[value + 1] - starts[value]
        window = np.repeat(np.arange(len(prints)), count)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        windows.append(window)
        items.append(members[starts[value][window] + inside])
    pair = np.unique(np.concatenate(windows) * len(index.ids) + np.concatenate(items))
    window, item = pair // len(index.ids), pair % len(index.ids)
    distance = np.bitwise_count(prints[window] ^ index.fingerprint[item])
    keep = distance <= RADIUS
    return window[keep], item[keep], distance[keep]


def _weighted(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared weight over united weight."""
    _, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    shared = np.minimum(one[1][a], two[1][b]).sum()
    return float(shared / (one[1].sum() + two[1].sum() - shared))


def matches(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int, float]]:
    """``row, item, first word, words, distance, likeness`` of the best window of each row and item found."""
    words = split_words(*offsets_of(column), lower=True)
    best: dict[tuple[int, int], tuple] = {}

    def found(row: int, item: int, start: int, size: int, distance: int, likeness: float) -> None:
        new = (-likeness, start, size, distance)
        if likeness >= LIKENESS and new < best.get((row, item), (1,)):
            best[row, item] = new

    if index.ids and len(words.starts):
        hashes = word_hashes(words)
        for k in index.known:
            values, whole = _grams(hashes, words.first, k)
            hit = whole & _member(values, index.known[k])
            if k < SHINGLE:
                _short(index, words, values, hit, k, found)
            elif hit.any():
                _long(index, words, values, whole, hit, found)
    return [(row, item, start, size, distance, -minus) for (row, item), (minus, start, size, distance) in sorted(best.items())]


def _short(index: Index, words: Words, values: np.ndarray, hit: np.ndarray, k: int, found) -> None:
    """Items shorter than a shingle: their whole sequence is the one shingle, so its first place in a row is the best."""
    at = np.flatnonzero(hit)
    rows = np.searchsorted(words.first, at, "right") - 1
    order = np.lexsort((at, values[at], rows))
    at, rows = at[order], rows[order]
    new = np.ones(len(at), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[at[1:]] != values[at[:-1]])
    at, rows = at[new], rows[new]
    for begin in range(0, len(at), _CHUNK_WORDS):
        part, of = at[begin : begin + _CHUNK_WORDS], rows[begin : begin + _CHUNK_WORDS]
        for w, item, distance in zip(*_candidates(index, k, _pack(_signs(values[part]))), strict=True):
            if index.shingles[item][0][0] == values[part[w]]:
                found(int(of[w]), int(item), int(part[w] - words.first[of[w]]), k, int(distance), 1.0)


def _long(index: Index, words: Words, values, whole, hit, found) -> None:
    """Rows with enough hits, packed or cut into blocks of about equal words.

    A block of a longer row reaches past its own words as far as the longest
    item does, so that every window lies whole in the block of its first word.
    """
    sizes = np.unique(index.length[index.length >= SHINGLE])
    least = math.ceil(LIKENESS * (sizes[0] - SHINGLE + 1))
    per_row = np.add.reduceat(np.append(hit, False), words.first[:-1]) * (words.per_row > 0)
    rows = np.flatnonzero(per_row >= least)
    pieces = -(-words.per_row[rows] // _CHUNK_WORDS)
    row = np.repeat(rows, pieces)
    skip = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _CHUNK_WORDS
    left = words.per_row[row] - skip
    own, span = np.minimum(left, _CHUNK_WORDS), np.minimum(left, _CHUNK_WORDS + sizes[-1] - 1)
    begin = 0
    while begin < len(row):
        end = begin + max(1, int(np.searchsorted(np.cumsum(span[begin : begin + _CHUNK_WORDS]), _CHUNK_WORDS)))
        part = slice(begin, end)
        low = words.first[row[part]] + skip[part]
        take = np.concatenate([np.arange(a, b) for a, b in zip(low, low + span[part], strict=True)])
        block = Block(row[part], words.per_row[row[part]], skip[part], own[part], span[part])
        _windows(index, block, values[take], whole[take], hit[take], sizes, found)
        begin = end


@dataclass
class Block:
    """Pieces of rows: words of the whole row and before the piece, words whose windows it decides, words it holds."""

    row: np.ndarray
    count: np.ndarray
    skip: np.ndarray
    own: np.ndarray
    span: np.ndarray


def _windows(index: Index, block: Block, values, whole, hit, sizes, found) -> None:
    """All windows of a block that can be like an item."""
    n = len(values)
    lanes = np.zeros((n + 1, 64), np.int32)
    np.cumsum(_signs(values) * whole[:, None], axis=0, out=lanes[1:])
    hits = np.append(0, np.cumsum(hit))
    piece = np.repeat(np.arange(len(block.row)), block.span)
    inside = np.arange(n) - np.repeat(np.cumsum(block.span) - block.span, block.span)
    place, count, mine = inside + block.skip[piece], block.count[piece], inside < block.own[piece]
    for size in sizes.tolist():
        width = size - SHINGLE + 1
        last = np.where(place + size <= count, width, np.where(place == 0, count - SHINGLE + 1, 0)) * mine
        stop = np.arange(n) + np.maximum(last, 0)
        at = np.flatnonzero((last > 0) & (hits[stop] - hits[:-1] >= LIKENESS * width))
        if not len(at):
            continue
        window, item, distance = _candidates(index, size, _pack(lanes[stop[at]] - lanes[at]))
        for w, i, d in zip(at[window].tolist(), item.tolist(), distance.tolist(), strict=True):
            own = np.unique(values[w : stop[w]], return_counts=True)
            likeness = _weighted(own, index.shingles[i])
            found(int(block.row[piece[w]]), i, int(place[w]), int(stop[w] - w + SHINGLE - 1), d, likeness)


def _passes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes that together cover the benchmark, each over a bounded share of its text."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    for k in range(passes):
        share = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(passes)) == k).collect()
        yield build_index(sorted(((r.item_id, r.text) for r in share), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance, likeness``: each benchmark item found in each document.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. The window of most
    likeness is named, of equal ones the first. A document shorter than an item is
    one window for it. An item with fewer than five words has its whole sequence
    as its one shingle. Fingerprints of a very long text are summed in blocks of
    ``_CHUNK_WORDS`` words, which overlap by the longest item. Null or wordless texts and items match nothing; repeated
    rows are found each; other columns are ignored; empty tables give an empty
    result.
    """
    kind = "doc_id long, item_id long, start_word long, n_words long, distance long, likeness double"
    out = docs.sparkSession.createDataFrame([], kind)
    for index in _passes(benchmark):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches):
                rows = matches(index, batch.column("text"))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield arrow_batch(
                    {
                        "doc_id": batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                        "item_id": pa.array([index.ids[i] for i in columns[1]], pa.int64()),
                        "start_word": pa.array(columns[2], pa.int64()),
                        "n_words": pa.array(columns[3], pa.int64()),
                        "distance": pa.array(columns[4], pa.int64()),
                        "likeness": pa.array(columns[5], pa.float64()),
                    }
                )

        out = out.union(docs.select("doc_id", "text").mapInArrow(find, kind))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in whose text no benchmark item is found; all columns stay."""
    for index in _passes(benchmark):

        @row_udf(T.BooleanType())
        def leaking(column: pa.Array, index=index) -> pa.Array:
            flag = np.zeros(len(column), bool)
            flag[[m[0] for m in matches(index, column)]] = True
            return pa.array(flag)

        docs = docs.where(~leaking("text"))
    return docs
