"""Fill-in-the-middle documents, cut by an indexable skip list.

A text is a list of units, its lines. The lowest lane of the list holds every
unit; each lane above holds about a quarter of the nodes below, and a node
carries how many units and how many code points it spans until the next node of
its lane. A cut rank is reached from the highest lane: forward while the spans
fit into what is left of the rank, then one lane down. The spans passed add up
to the exact code point of the cut. All lists of a batch are descended at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garoa.llm.arrow_words import mix
from garoa.llm.shared import arrow_batch, by_bytes, offsets_of

SEED = 7
#: Documents of a hundred that are transformed, and of these the share in suffix-first form.
RATE, SUFFIX_FIRST = 100, 50
#: Control strings of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class SkipLists:
    """One skip list per text. Every lane ends in a node without width, its tail."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """``data`` holds UTF-8 texts, one after the other, bounded by ``offsets``."""
        n = len(offsets) - 1
        ends = np.flatnonzero(data == 10) + 1
        last = offsets[1:][(np.diff(offsets) > 0) & (data[offsets[1:] - 1] != 10)] if len(data) else ends
        ends = np.sort(np.concatenate([ends, last]))
        first = np.searchsorted(ends, offsets, side="right")
        self.units = np.diff(first)
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        width = np.diff(points[np.append(0, ends)])
        head = first[:-1] + np.arange(n)
        real = np.ones(len(ends) + n, bool)
        real[head + self.units] = False
        chars = np.zeros(len(real), np.int64)
        chars[real] = width
        #: Lanes from the lowest: units and code points of each node, its place in the lane below, and the head of each list.
        self.lanes = [(real.astype(np.int64), chars, np.arange(len(real)), head)]
        rank = np.arange(len(real)) - np.repeat(head, self.units + 1)
        height = mix(rank.astype(np.uint64))
        tail = ~real
        while len(real) > 2 * n:
            units, chars, _, head = self.lanes[-1]
            keep = (height & np.uint64(3)) == 0
            keep[head] = True
            keep |= tail
            at = np.flatnonzero(keep)
            up = np.searchsorted(at, head)
            self.lanes.append((np.add.reduceat(units, at), np.add.reduceat(chars, at), at, up))
            height, tail, real = height[at] >> np.uint64(2), tail[at], real[at]

    def code_points(self, rows: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Code points before the unit of each rank in the list of each row; ``ranks`` are at most its units."""
        left, passed = ranks.astype(np.int64), np.zeros(len(rows), np.int64)
        at = self.lanes[-1][3][rows]
        for lane, (units, chars, below, _) in reversed(list(enumerate(self.lanes))):
            going = np.flatnonzero((units[at] > 0) & (units[at] <= left))
            while len(going):
                node = at[going]
                left[going] -= units[node]
                passed[going] += chars[node]
                at[going] = node + 1
                node = at[going]
                going = going[(units[node] > 0) & (units[node] <= left[going])]
            if lane:
                at = below[at]
        return passed


def _assemble(batches: Iterator[pa.RecordBatch], rate: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        data, offsets = offsets_of(batch.column("text"))
        lists, rows = SkipLists(data, offsets), np.arange(batch.num_rows)
        h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
        ranks = np.sort([h[0] % (lists.units + 1), h[1] % (lists.units + 1)], axis=0)
        low, high = (lists.code_points(rows, r) for r in ranks)
        outputs, forms = [], []
        texts = batch.column("text").to_pylist()
        for i, text in enumerate(texts):
            text = text or ""
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2][i] % 100 >= rate:
                forms.append("plain")
                outputs.append(text)
                continue
            prefix, middle, suffix = text[: low[i]], text[low[i] : high[i]], text[high[i] :]
            if h[3][i] % 100 < suffix_first:
                forms.append("spm")
                outputs.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
            else:
                forms.append("psm")
                outputs.append(f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
        plain = np.array([f == "plain" for f in forms], bool)
        yield arrow_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n": lists.units.astype(np.int64),
                "form": pa.array(forms, pa.string()),
                "prefix_chars": pa.array(low, pa.int64(), mask=plain),
                "middle_chars": pa.array(high - low, pa.int64(), mask=plain),
                "output": pa.array(outputs, pa.string()),
            }
        )


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs(doc_id, text, ...)``.

    Four numbers are drawn from the hash of seed and id; two of them cut the text
    between lines, one chooses whether it is transformed, one the order of its
    parts. An empty or null text, or one that holds a control string, stays plain,
    with null widths. A text without line ends is one unit. A null id is hashed
    as an empty one; rows of one id are cut at ranks drawn alike, each in its own
    text; other columns are ignored; an empty table gives an empty result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _assemble(batches, rate, suffix_first)

    kind = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long"), "text", *drawn).mapInArrow(assemble, kind)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: no part holds a control string, so they bound the parts."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(part[2], part[3], part[1]))
