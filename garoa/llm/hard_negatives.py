"""Hard negatives by exact inner products of quantised vectors, several at a time.

Components become integers and are biased to be non-negative, so that those of
several candidates can lie side by side in separated fields of one wide integer.
Multiplying it by an anchor's biased component multiplies every field at once;
the fields are as wide as the largest sum of products, so none runs into the next
and the sums are exact. The wide integers are held in doubles while they stay
under 2**53, where products and sums of doubles are exact, and else in integers
of any width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from garoa.llm.shared import arrow_batch, checkpointed

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's, from and to.
LOW, HIGH = 50, 95
#: Bytes of quantised anchors that are held at once, by the driver and by every task; more go in further passes.
PASS_BYTES = 16 << 20
#: Anchors and candidates of one product.
ANCHORS, CANDIDATES = 512, 8192
_EXACT = 53
_WIDE_FIELDS = 8
_NONE = np.iinfo(np.int64).min


@dataclass
class Packing:
    """Fields of wide integers for vectors of ``dim`` components from ``low`` to ``high``."""

    dim: int
    low: int
    high: int

    @property
    def width(self) -> int:
        """Bits of a field: of the largest sum of products of biased components."""
        return max(1, (self.dim * (self.high - self.low) ** 2).bit_length())

    @property
    def fields(self) -> int:
        return max(1, _EXACT // self.width) if self.width <= _EXACT else _WIDE_FIELDS

    @property
    def kind(self) -> type:
        return np.float64 if self.width <= _EXACT else object

    @property
    def bound(self) -> int:
        """No inner product is beyond it."""
        return self.dim * max(-self.low, self.high) ** 2

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Wide integers of candidates: ``dim`` by their number over ``fields``, rounded up."""
        wide = np.zeros((-(-len(rows) // self.fields), self.fields, self.dim), self.kind)
        wide.reshape(len(wide) * self.fields, self.dim)[: len(rows)] = rows - self.low
        places = np.array([1 << (self.width * k) for k in range(self.fields)], self.kind)
        return (wide * places[:, None]).sum(1).T

    def products(self, anchors: np.ndarray, packed: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products of anchors and the candidates ``rows`` that ``packed`` holds."""
        wide = (anchors - self.low).astype(self.kind) @ packed
        out = np.empty((len(anchors), packed.shape[1], self.fields), np.int64)
        if self.kind is object:
            mask = (1 << self.width) - 1
            bias = self.low * (anchors.astype(object).sum(1)[:, None] + rows.astype(object).sum(1)) - self.dim * self.low**2
            parts = [(wide >> (self.width * k)) & mask for k in range(self.fields)]
            whole = np.stack(parts, 2).reshape(len(anchors), -1)[:, : len(rows)]
            return (whole + bias).astype(np.int64)
        wide, mask = wide.astype(np.int64), (1 << self.width) - 1
        for k in range(self.fields):
            out[:, :, k] = (wide >> (self.width * k)) & mask
        bias = self.low * (anchors.sum(1)[:, None] + rows.sum(1)) - self.dim * self.low**2
        return out.reshape(len(anchors), -1)[:, : len(rows)] + bias


def quantized(column: pa.Array, dim: int, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of each component; shorter vectors are filled with zeros."""
    if len(column) and not isinstance(column, (pa.ListArray, pa.LargeListArray)):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return out


class Best:
    """The ``k`` best scores of each of ``n`` lists, ties by smaller id."""

    def __init__(self, n: int, k: int, bound: int):
        self.k, self.bound = k, bound
        self.score = np.full((n, k), _NONE)
        self.ids = np.zeros((n, k), np.int64)

    def add(self, begin: int, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of lists ``begin`` and on; ``ids`` must ascend."""
        n = scores.shape[1]
        k = min(self.k, n)
        if (self.bound + 1) * n < 1 << 61:
            key = np.where(allowed, scores * n - np.arange(n), _NONE)
            pick = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            key = np.where(allowed, scores, _NONE)
            pick = np.argsort(-np.maximum(key, _NONE + 1), axis=1, kind="stable")[:, :k]
        new = np.where(np.take_along_axis(allowed, pick, 1), np.take_along_axis(scores, pick, 1), _NONE)
        own = slice(begin, begin + len(scores))
        score = np.concatenate([self.score[own], new], 1)
        names = np.concatenate([self.ids[own], ids[pick]], 1)
        order = np.lexsort((names, -np.maximum(score, _NONE + 1)), axis=1)[:, : self.k]
        self.score[own] = np.take_along_axis(score, order, 1)
        self.ids[own] = np.take_along_axis(names, order, 1)


@dataclass
class Anchors:
    """Anchors of a pass, and the scores and ids of their positives once known."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    scores: np.ndarray | None = None
    positives: np.ndarray | None = None


def _candidates(batches: Iterator[pa.RecordBatch], packing: Packing) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, labels, rows and packed rows, by ascending id, of about ``CANDIDATES`` rows at a time."""
    step = max(1, min(CANDIDATES, (CANDIDATES << 8) // max(packing.dim, 1)))
    for batch in batches:
        for begin in range(0, batch.num_rows, step):
            part = batch.slice(begin, step)
            ids = part.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            rows = quantized(part.column("embedding"), packing.dim)[order]
            yield ids[order], part.column("label").to_numpy()[order], rows, packing.pack(rows)


def _positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, packing: Packing, count: int) -> Iterator[pa.RecordBatch]:
    """The best rows of each anchor's label that a task sees."""
    best = Best(len(anchors.ids), count, packing.bound)
    for ids, labels, rows, packed in _candidates(batches, packing):
        for begin in range(0, len(anchors.ids), ANCHORS):
            own = slice(begin, begin + ANCHORS)
            scores = packing.products(anchors.rows[own], packed, rows)
            allowed = (anchors.labels[own, None] == labels) & (anchors.ids[own, None] != ids)
            best.add(begin, scores, allowed, ids)
    anchor, _ = found = np.nonzero(best.score != _NONE)
    yield arrow_batch({"anchor": anchor.astype(np.int32), "score": best.score[found], "vec_id": best.ids[found]})


def _negatives(
    batches: Iterator[pa.RecordBatch], anchors: Anchors, packing: Packing, count: int, low: int, high: int
) -> Iterator[pa.RecordBatch]:
    """The best rows of other labels in the band of each anchor and positive that a task sees."""
    n, per = anchors.scores.shape
    bests = [Best(n, count, packing.bound) for _ in range(per)]
    for ids, labels, rows, packed in _candidates(batches, packing):
        for begin in range(0, n, ANCHORS):
            own = slice(begin, begin + ANCHORS)
            scores = packing.products(anchors.rows[own], packed, rows)
            other = anchors.labels[own, None] != labels
            for j, best in enumerate(bests):
                least, most = _band(anchors.scores[own, j], low, high)
                best.add(begin, scores, other & (scores >= least[:, None]) & (scores <= most[:, None]), ids)
    for j, best in enumerate(bests):
        anchor, _ = found = np.nonzero(best.score != _NONE)
        yield arrow_batch(
            {
                "anchor": anchor.astype(np.int32),
                "place": np.full(len(anchor), j, np.int32),
                "anchor_id": anchors.ids[anchor],
                "positive_id": anchors.positives[anchor, j],
                "positive_score": anchors.scores[anchor, j],
                "negative_id": best.ids[found],
                "negative_score": best.score[found],
            }
        )


def _band(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer n with ``low * p <= 100 * n <= high * p``; an empty band without a positive."""
    known = [int(p) for p in positive]
    least = [1 if p == _NONE else -(-low * p // 100) for p in known]
    most = [0 if p == _NONE else high * p // 100 for p in known]
    return np.array(least, np.int64), np.array(most, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Anchors as packed blocks of ids, labels and components."""
    for batch in batches:
        parts = [batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), quantized(batch.column("embedding"), dim)]
        yield arrow_batch({c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("ids", "labels", "rows"), parts, strict=True)})


def _loaded(anchors: DataFrame, dim: int) -> Anchors:
    """The anchors of a pass on the driver, by id."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, dim)

    held = anchors.mapInArrow(blocks, "ids binary, labels binary, rows binary").collect()
    ids, labels, rows = (np.frombuffer(b"".join(bytes(r[c]) for r in held), np.int64) for c in ("ids", "labels", "rows"))
    rows = rows.reshape(len(ids), dim)
    order = np.lexsort((*rows.T[::-1], labels, ids))
    return Anchors(ids[order], labels[order], rows[order])


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors(vec_id, embedding, label, ...)``; ``anchor`` says which rows are
    anchors, a stated query set. They are read in passes of at most
    ``pass_bytes``, and every pass meets all rows twice: for the positives of each
    anchor, then for the negatives in the band of each positive. A task keeps the
    best of each anchor, so it emits no pairs but those. Rows with a null id,
    label or vector, or with a null or non-finite component, take no part; shorter
    vectors count as filled with zeros. Ties go to the smaller id. A row is no
    partner of anchors of its own id; repeated rows count each, and repeated
    anchors are answered each. Other columns are ignored; an empty table gives an
    empty result. Vectors whose inner products may not fit a long are an error.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = vectors.select(
        F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long").alias("label"), anchor.alias("is_anchor")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    facts = usable.agg(
        F.max(F.size(x)).alias("dim"),
        F.min(F.array_min(x)).alias("low"),
        F.max(F.array_max(x)).alias("high"),
        F.count_if(F.col("is_anchor")).alias("anchors"),
    ).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.anchors:
        return spark.createDataFrame([], kind)
    edge = [int(np.floor(SCALE * float(v or 0))) for v in (facts.low, facts.high)]
    packing = Packing(facts.dim, min(0, edge[0]), max(0, edge[1]))
    if packing.bound >= 1 << 60:
        raise ValueError(f"inner products of components from {packing.low} to {packing.high} may not fit a long")
    rows = usable.select("vec_id", "embedding", "label")
    passes = -(-facts.anchors * max(facts.dim, 1) * 8 // pass_bytes)
    chosen = usable.where("is_anchor").select("vec_id", "embedding", "label", F.floor(F.rand(0) * passes).alias("pass"))
    chosen = chosen if passes == 1 else checkpointed(chosen)
    out = spark.createDataFrame([], kind)
    for number in range(passes):
        found = _pass(rows, _loaded(chosen.where(F.col("pass") == number), packing.dim), packing, positives, negatives, low, high)
        out = out.union(found if passes == 1 else checkpointed(found))
    return out


def _pass(rows: DataFrame, anchors: Anchors, packing: Packing, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _positives(batches, anchors, packing, positives)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    first = rows.mapInArrow(near, "anchor int, score long, vec_id long").withColumn("k", F.row_number().over(best))
    held = first.where(F.col("k") <= positives).toArrow()
    anchors.scores = np.full((len(anchors.ids), positives), _NONE)
    anchors.positives = np.zeros((len(anchors.ids), positives), np.int64)
    at = held.column("anchor").to_numpy(), held.column("k").to_numpy() - 1
    anchors.scores[at], anchors.positives[at] = held.column("score").to_numpy(), held.column("vec_id").to_numpy()

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _negatives(batches, anchors, packing, negatives, low, high)

    kind = "anchor int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = rows.mapInArrow(band, kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
