"""Repeated passages, by FM-indexes over shards of candidate text.

A window is 20 consecutive words. Its anchor is the least hash of its four-word
grams, so equal windows have equal anchors wherever they are. Consecutive windows
of one anchor at one place form a segment; segments of an anchor meet in one shard. There the
oldest of equal segments stands for all, the others are repeats. Where an anchor
has several different segments, they are indexed: a compressed FM-index per shard,
in which backward search finds the stretches of each segment that an older place
repeats, and reports those of a window or more. An anchor of too many different
segments for one index is taken apart into single windows, which are aggregated
by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garoa.llm.arrow_words import mix, powers, split_words, word_hashes
from garoa.llm.fm_index import FMIndex
from garoa.llm.shared import arrow_batch, by_bytes, checkpointed, offsets_of

WINDOW = 20
GRAM = 4
GRAMS = WINDOW - GRAM + 1
SEGMENT = 2 * WINDOW - GRAM
#: Different segments of one anchor above which they are taken apart into windows, not indexed.
CROWD = 10_000
#: Words after which a shard begins another index, at the next anchor.
INDEX_WORDS = 400_000
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _anchors(hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each word and where it is first; the last words have none and get 0 and -1."""
    n = len(hashes)
    out, place = np.zeros(n, np.uint64), np.full(n, -1)
    if n >= WINDOW:
        scale, m = powers(_BASE, GRAM), n - GRAM + 1
        gram = np.zeros(m, np.uint64)
        for j in range(GRAM):
            gram += hashes[j : j + m] * scale[j]
        gram = mix(gram + np.uint64(order))
        at, span = np.arange(m), 1
        while span < GRAMS:
            step = min(span, GRAMS - span)
            left, right = at[:-step], at[step:]
            at, span = np.where(gram[left] <= gram[right], left, right), span + step
        out[: len(at)], place[: len(at)] = gram[at], at
    return out, place


def _segments(hashes: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, windows and anchor of the segments of each row.

    Windows of a segment share one place of their anchor, first in each: no two
    of them are equal, and a segment has at most ``SEGMENT`` words.
    """
    anchor, place = _anchors(hashes, order)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= first[row + 1])
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(at)))
    start = at[begin]
    return row[start], start - first[row[start]], windows, anchor[start]


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each document; those that the batch repeats are merged into ``known`` repeats at once."""
    for batch in by_bytes(batches):
        words = split_words(*offsets_of(batch.column("text")))
        hashes = word_hashes(words)
        row, start, windows, anchor = _segments(hashes, words.first, 0)
        ids = batch.column("doc_id").to_numpy()
        doc = ids[row]
        sums = np.append(np.uint64(0), np.cumsum(hashes * powers(_BASE, len(hashes))))
        begin = words.first[row] + start
        segment = (sums[begin + windows + WINDOW - 1] - sums[begin]) * powers(_INVERSE, len(hashes) + 1)[begin]
        segment = mix(segment + windows.astype(np.uint64)).view(np.int64)
        order = np.lexsort((start, doc, segment))
        s, d, t = segment[order], doc[order], start[order]
        same = np.append(False, s[1:] == s[:-1])[: len(s)]
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(s)))) if len(s) else order
        known = np.zeros(len(s), bool)
        known[order] = same & ((d != d[lead]) | (t != t[lead]))
        follows = np.zeros(len(s), bool)
        follows[1:] = known[1:] & known[:-1] & (row[1:] == row[:-1])
        heads = np.flatnonzero(~follows)
        total = np.add.reduceat(windows, heads) if len(heads) else windows
        spread = mix(doc[heads].astype(np.int64).view(np.uint64) ^ mix(start[heads].astype(np.uint64)))
        yield arrow_batch(
            {
                "anchor": np.where(known[heads], spread, anchor[heads]).view(np.int64),
                "segment": segment[heads],
                "doc_id": doc[heads].astype(np.int64),
                "start": start[heads].astype(np.int32),
                "windows": total.astype(np.int32),
                "known": known[heads],
            }
        )


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many segments of a batch have each anchor."""
    for batch in by_bytes(batches):
        words = split_words(*offsets_of(batch.column("text")))
        anchor, n = np.unique(_segments(word_hashes(words), words.first, 0)[3], return_counts=True)
        yield arrow_batch({"anchor": anchor.view(np.int64), "n": n.astype(np.int64)})


def _wanted(batch: pa.RecordBatch) -> tuple:
    """Words of a batch, and row, first word, windows and anchor of its wanted ``segments``."""
    words = split_words(*offsets_of(batch.column("text")))
    wanted = batch.column("segments")
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(wanted.offsets)))
    part = wanted.flatten()
    start, windows, anchor = (part.field(c).to_numpy().astype(np.int64) for c in ("start", "windows", "anchor"))
    inside = start + windows + WINDOW - 1 <= words.per_row[row]
    return words, row[inside], start[inside], windows[inside], anchor[inside]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments to be indexed."""
    for batch in by_bytes(batches):
        words, row, start, windows, anchor = _wanted(batch)
        hashes = word_hashes(words)
        size = windows + WINDOW - 1
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        take = np.repeat(words.first[row] + start - offsets[:-1], size) + np.arange(offsets[-1])
        yield arrow_batch(
            {
                "anchor": anchor,
                "doc_id": batch.column("doc_id").to_numpy()[row].astype(np.int64),
                "start": start.astype(np.int32),
                "words": pa.ListArray.from_arrays(offsets, hashes[take].view(np.int64)),
            }
        )


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes and the place of each window of the segments of crowded anchors."""
    for batch in by_bytes(batches):
        words, row, start, windows, _ = _wanted(batch)
        hashes = word_hashes(words)
        n = len(hashes) - WINDOW + 1
        codes = []
        for salt in (1, 2):
            own = mix(hashes + np.uint64(salt))
            code = np.zeros(max(n, 0), np.uint64)
            for j, scale in enumerate(powers(_BASE, WINDOW) if n > 0 else ()):
                code += own[j : j + n] * scale
            codes.append(mix(code).view(np.int64))
        step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        own_row, place = np.repeat(row, windows), np.repeat(start, windows) + step
        at = words.first[own_row] + place
        yield arrow_batch(
            {
                "code": codes[0][at],
                "check": codes[1][at],
                "doc_id": batch.column("doc_id").to_numpy()[own_row].astype(np.int64),
                "start": place.astype(np.int32),
            }
        )


def _search(rows: pa.Table) -> pa.RecordBatch:
    """Index the segments of some anchors and report what older places repeat."""
    rows = rows.combine_chunks()
    lists = rows.column("words").chunk(0)
    first = np.asarray(lists.offsets).astype(np.int64)
    hashes = lists.values.to_numpy()[first[0] : first[-1]]
    first = first - first[0]
    symbols = np.unique(hashes, return_inverse=True)[1] + 1
    doc, start = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy().astype(np.int64)
    place = np.arange(len(symbols)) - np.repeat(first[:-1] - start, np.diff(first))
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int64)
    age = (np.repeat(rank, np.diff(first)) << 32) | place
    begin, end = FMIndex(symbols, first, age, SEGMENT).matches(first, WINDOW)
    of = np.searchsorted(first, begin, side="right") - 1
    shift = start[of] - first[of]
    return arrow_batch({"doc_id": doc[of], "low": (begin + shift).astype(np.int32), "high": (end + shift).astype(np.int32)})


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor; an index is built for about ``INDEX_WORDS`` words, never within an anchor."""
    held: list[pa.Table] = []
    words = 0
    for batch in batches:
        while batch.num_rows:
            ends = np.cumsum(np.diff(np.asarray(batch.column("words").offsets)))
            anchor = batch.column("anchor").to_numpy()
            bounds = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            if held and held[-1].column("anchor")[-1].as_py() == anchor[0]:
                bounds = bounds[1:]
            full = bounds[words + np.append(0, ends)[bounds] >= INDEX_WORDS]
            if not len(full):
                held.append(pa.Table.from_batches([batch]))
                words += int(ends[-1])
                break
            cut = int(full[0])
            yield _search(pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, cut)])]))
            held, words, batch = [], 0, batch.slice(cut)
    if held:
        yield _search(pa.concat_tables(held))


def repeats(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> tuple[DataFrame, DataFrame]:
    """``doc_id, low, high`` of words that windows repeating an older one cover, and ``columns`` of the documents with an id.

    Older is a smaller id, or the same and an earlier word. Every repeated window
    lies in a reported stretch; stretches overlap. Texts are joined by id with all
    their ``columns``, so that every join of the plan reads one and the same exchange.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where("doc_id is not null").select(*columns)
    plain = texts.select("doc_id", "text")
    kind = "anchor long, segment long, doc_id long, start int, windows int, known boolean"
    counts = plain.mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    met = plain.mapInArrow(_segment_rows, kind).join(counts.hint("merge"), "anchor", "left")
    met = checkpointed(met.where("known or n is not null").drop("n"))
    oldest = met.where("not known").groupBy("anchor", "segment")
    oldest = checkpointed(oldest.agg(F.min(F.struct("doc_id", "start")).alias("oldest"), F.first("windows").alias("windows")))
    repeat = F.col("known") | (F.struct("doc_id", "start") != F.col("oldest"))
    whole = met.join(oldest.select("anchor", "segment", "oldest").hint("merge"), ["anchor", "segment"], "left").where(repeat)
    whole = whole.select("doc_id", F.col("start").alias("low"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("high"))
    crowds = oldest.groupBy("anchor").agg(F.count("*").alias("crowd")).where("crowd > 1")
    several = oldest.join(crowds.hint("merge"), "anchor").select("oldest.*", "windows", "anchor", "crowd")

    def with_texts(segments: DataFrame) -> DataFrame:
        listed = segments.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "anchor")).alias("segments"))
        return texts.join(listed.hint("merge"), "doc_id")

    pieces = with_texts(several.where(F.col("crowd") <= CROWD))
    pieces = pieces.mapInArrow(_pieces, "anchor long, doc_id long, start int, words array<long>")
    shards = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = whole.union(shards.mapInArrow(_shard, "doc_id long, low int, high int"))
    if not crowds.where(F.col("crowd") > CROWD).isEmpty():
        found = found.union(_crowded_repeats(with_texts(several.where(F.col("crowd") > CROWD))))
    return found, texts


def _crowded_repeats(segments: DataFrame) -> DataFrame:
    """Windows of crowded anchors that are not the oldest of their equals, one by one.

    They are aggregated before they move, so neither an anchor nor a window is
    gathered in one task. They are made twice, from the same exchange of texts.
    """
    windows = segments.mapInArrow(_single_windows, "code long, check long, doc_id long, start int")
    oldest = windows.groupBy("code", "check").agg(F.min(F.struct("doc_id", "start")).alias("oldest"), F.count("*").alias("n"))
    met = windows.join(oldest.where("n > 1").drop("n").hint("merge"), ["code", "check"])
    late = met.where(F.struct("doc_id", "start") != F.col("oldest"))
    return late.select("doc_id", F.col("start").alias("low"), (F.col("start") + WINDOW).alias("high"))


def _cut(batches: Iterator[pa.RecordBatch], carry: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Texts without the words that the stretches cover."""
    for batch in by_bytes(batches):
        words = split_words(*offsets_of(batch.column("text")))
        cuts = batch.column("cuts")
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(cuts.offsets)))
        part = cuts.flatten()
        edge = np.zeros(len(words.starts) + 1, np.int64)
        for name, sign in (("low", 1), ("high", -1)):
            place = np.minimum(part.field(name).to_numpy(), words.per_row[row])
            np.add.at(edge, words.first[row] + place, sign)
        keep = np.cumsum(edge)[:-1] == 0
        starts, size = words.starts[keep], words.ends[keep] - words.starts[keep] + 1
        offsets = np.append(0, np.cumsum(size))
        take = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
        data = np.append(words.data, np.uint8(32))[take]
        data[offsets[1:] - 1] = 32
        kept = np.append(0, np.cumsum(keep))[words.first]
        raw, low = data.tobytes(), offsets[kept]
        texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(low[:-1], low[1:], strict=True)]
        yield arrow_batch(
            {
                **{c: batch.column(c) for c in carry},
                "n_words": words.per_row.astype(np.int64),
                "n_removed": words.per_row - np.diff(kept),
                "kept": pa.array(texts, pa.string()),
            }
        )


def remove_repeats(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` and ``n_words, n_removed, kept`` per row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window over it
    also starts earlier, at a smaller id or in the same document; windows are
    judged on the input. ``kept`` joins the other words by one space. A null text
    has no words; a text under 20 words loses none. Rows without id are compared
    with nothing and lose nothing. Equal repeated rows do not count as earlier
    than each other; rows of one id with different texts lose what any of them
    would, by word number. Other columns are ignored unless carried; their names may be
    anything but the result's. An empty table gives an empty result.
    """
    columns = list(dict.fromkeys((*carry, "doc_id", "text")))
    stretches, texts = repeats(docs, columns)
    cuts = stretches.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    none = F.array().cast("array<struct<low:int,high:int>>")
    joined = texts.join(cuts.hint("merge"), "doc_id", "left").withColumn("cuts", F.coalesce("cuts", none))
    nameless = docs.where("doc_id is null").select(*columns, none.alias("cuts"))
    kind = ", ".join(f"`{c}` {t}" for c, t in docs.select(*carry).dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, carry)

    return joined.unionByName(nameless).mapInArrow(cut, f"{kind}, n_words long, n_removed long, kept string")
