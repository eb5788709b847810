"""Document fingerprints as invertible Bloom lookup sketches.

A text is a multiset of paragraphs: runs of at most four words that end at a line
end or at a word whose hash says so, hence an edit moves few bounds. Each
paragraph's digest goes into three cells of a sketch, one per third, which keep
count, xor of digests and xor of their checks. Two sketches subtract cell by
cell; peeling cells of one digest recovers what the two texts do not share. Where
it stops early, both sketches are built anew four times as large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garoa.llm.arrow_words import mix, split_words, word_hashes
from garoa.llm.shared import arrow_batch

CELLS = 24
GROWTH = 4
BREAK = np.uint64(3)
LONGEST = 4
BATCH_BYTES = 1 << 20
_HASHES = 3
_NEWLINE = 10


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraphs of each text, and their rows; the k-th equal one differs from the first."""
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw], dtype=np.int64)).astype(np.int64)
    words = split_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, rows = word_hashes(words), words.rows()
    lines = np.append(0, np.cumsum(words.data == _NEWLINE))
    last = np.ones(n, bool)
    last[:-1] = (hashes[:-1] % BREAK == 0) | (rows[1:] != rows[:-1]) | (lines[words.starts[1:]] != lines[words.ends[:-1]])
    begin, size, place = _runs(last)
    last |= (place + 1) % LONGEST == 0
    begin, size, place = _runs(last)
    digest = mix(np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin) + size.astype(np.uint64))
    row = rows[begin]
    order = np.lexsort((digest, row))
    digest, row = digest[order], row[order]
    same = np.append(False, (digest[1:] == digest[:-1]) & (row[1:] == row[:-1]))
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return mix(digest + (np.arange(len(same)) - run).astype(np.uint64)), row


def _runs(last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size of runs whose ends are marked, and each element's place in its run."""
    begin = np.append(0, np.flatnonzero(last)[:-1] + 1)
    size = np.diff(np.append(begin, len(last)))
    return begin, size, np.arange(len(last)) - np.repeat(begin, size)


def sketch(digests: np.ndarray, rows: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checks of the cells of n sketches, each a row."""
    count, key, check = np.zeros((n, cells), np.int64), np.zeros((n, cells), np.uint64), np.zeros((n, cells), np.uint64)
    _toggle(count, key, check, digests, rows, np.ones(len(digests), np.int64))
    return count, key, check


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    third = cells // _HASHES
    return np.stack([(mix(digests + np.uint64(j + 1)) % np.uint64(third)).astype(np.int64) + j * third for j in range(_HASHES)])


def _toggle(count, key, check, digests, rows, sign) -> None:
    cells = count.shape[1]
    checks = mix(digests ^ np.uint64(0xC2B2AE3D27D4EB4F))
    for place in _places(digests, cells):
        at = rows * cells + place
        np.add.at(count.reshape(-1), at, sign)
        np.bitwise_xor.at(key.reshape(-1), at, digests)
        np.bitwise_xor.at(check.reshape(-1), at, checks)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digests recovered from differences of sketches, their rows and signs, and which rows came out whole."""
    found: list[tuple[np.ndarray, ...]] = []
    while True:
        pure = (np.abs(count) == 1) & (check == mix(key ^ np.uint64(0xC2B2AE3D27D4EB4F)))
        rows, cells = np.nonzero(pure)
        if not len(rows):
            break
        digests, sign = key[rows, cells], count[rows, cells]
        order = np.lexsort((digests, rows))
        rows, digests, sign = rows[order], digests[order], sign[order]
        first = np.append(True, (rows[1:] != rows[:-1]) | (digests[1:] != digests[:-1]))
        rows, digests, sign = rows[first], digests[first], sign[first]
        _toggle(count, key, check, digests, rows, -sign)
        found.append((digests, rows, sign))
    whole = ~(count.any(1) | key.any(1) | check.any(1))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), whole
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), whole)


def differences(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Paragraphs of row i of one and row i of two that the other has not, from subtracted sketches."""
    out, open_rows, cells = np.zeros(n, np.int64), np.arange(n), CELLS
    while len(open_rows):
        index = np.full(n, -1)
        index[open_rows] = np.arange(len(open_rows))
        parts = []
        for digests, rows in (one, two):
            at = index[rows]
            parts.append(sketch(digests[at >= 0], at[at >= 0], len(open_rows), cells))
        (c1, k1, h1), (c2, k2, h2) = parts
        _, rows, _, whole = peel(c1 - c2, k1 ^ k2, h1 ^ h2)
        out[open_rows] = np.bincount(rows, minlength=len(open_rows))
        open_rows, cells = open_rows[~whole], cells * GROWTH
    return out


def likeness(one, two, n: int) -> np.ndarray:
    """Shared paragraphs over all, 0 to 1, of row i of one and row i of two; two empty texts are alike."""
    total = np.bincount(one[1], minlength=n) + np.bincount(two[1], minlength=n)
    apart = differences(one, two, n)
    return np.where(total == 0, 1.0, (total - apart) / np.maximum(total + apart, 1))


def _strings(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> list[str]:
    cells = np.stack([count.astype(np.uint64), key, check], axis=2).astype(">u8")
    return [c[:, 0].astype(">u4").tobytes().hex() + c[:, 1:].tobytes().hex() for c in cells]


def _answers(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """One output row per document ``id, text, next text``."""
    texts = [r[1] for r in rows]
    following = [r[2] for r in rows]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    n = len(rows)
    own, new, after = paragraphs(texts), paragraphs(edited), paragraphs(following)
    return arrow_batch(
        {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "n_chars": np.array([len(t) for t in texts], np.int64),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            "fingerprint": pa.array(_strings(*sketch(*own, n, CELLS))),
            "edited_fingerprint": pa.array(_strings(*sketch(*new, n, CELLS))),
            "near_edited": likeness(own, new, n),
            "near_next": likeness(own, after, n),
        }
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and place; each is answered once the row after it is known."""
    held, pending, size = None, [], 0
    for batch in batches:
        for part, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
            text = text or ""
            if doc_id is None:
                answer = (None, text, text)
            elif held is not None and held[0] == part and not held[1]:
                answer = (held[2], held[3], text)
            else:
                answer = None
            if answer:
                pending.append(answer)
                size += len(answer[1]) + len(answer[2])
            if doc_id is not None:
                held = (part, ahead, doc_id, text)
            if size >= BATCH_BYTES:
                yield _answers(pending)
                pending, size = [], 0
    if pending:
        yield _answers(pending)


def _parts_of(bounds: list[int], first: int | None):
    """An Arrow function: the part of an id, and for an id at a bound also -1 minus the part before."""
    limits = np.array(bounds, np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def parts(ids: pa.Array) -> pa.Array:
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        part = np.searchsorted(limits, value, side="right")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        bound = known & ((value == first) if first is not None else False)
        at_limit = known & (part > 0)
        at_limit[at_limit] = limits[part[at_limit] - 1] == value[at_limit]
        ahead = np.where(bound, len(limits), part - 1)
        twice = bound | at_limit
        offsets = np.append(0, np.cumsum(1 + twice)).astype(np.int32)
        flat = np.empty(offsets[-1], np.int32)
        flat[offsets[:-1]] = part
        flat[offsets[1:][twice] - 1] = -1 - ahead[twice]
        return pa.ListArray.from_arrays(offsets, flat)

    return parts


def fingerprints(docs: DataFrame, parts_per_partition: int = 4) -> DataFrame:
    """Fingerprints of each text of ``docs(doc_id, text, ...)`` and of its edited text.

    The edited text has the last half of the code points replaced by the first
    as many, or all, of the next document by ``doc_id``, ties by text; the first
    follows the last, and a lone document follows itself. So does a row without
    id, which follows no other. A null text is empty; two empty texts are alike
    (1.0). Other columns are ignored; an empty table gives an empty result.

    Rows are dealt out once, by ranges of ids whose bounds are ids themselves;
    the document at a bound also goes to the range before it, as the one that
    follows its last. Only the bounds, a few per shuffle partition, come to the
    driver.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = partitions * parts_per_partition
    shares = [i / count for i in range(1, count)]
    facts = docs.agg(F.min("doc_id").alias("first"), F.percentile_approx("doc_id", shares, 100 * count).alias("cuts")).first()
    bounds = sorted(set(facts.cuts or ()) - {facts.first})
    dealt = docs.select("doc_id", "text", F.explode(_parts_of(bounds, facts.first)("doc_id")).alias("to"))
    ahead = F.col("to") < 0
    part = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")).when(ahead, -1 - F.col("to")).otherwise(F.col("to"))
    placed = dealt.select(part.alias("part"), ahead.alias("ahead"), "doc_id", "text")
    placed = placed.repartition(partitions, "part").sortWithinPartitions("part", "ahead", "doc_id", "text")
    return placed.mapInArrow(
        _walk,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
