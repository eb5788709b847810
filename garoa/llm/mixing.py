"""Mix sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from garoa.llm.arrow_words import split_words
from garoa.llm.shared import checkpointed, offsets_of, row_udf

SHARE = 1.5
EPOCHS = 2
SEED = 20
#: Patterns that a flow on the driver may route; of sources that no document shares with another, none is.
FLOW_PATTERNS = 4_000
#: Documents of a seeded bucket, about; running sums are made inside buckets.
BUCKET_ROWS = 20_000


@row_udf(T.LongType())
def word_count(column: pa.Array) -> pa.Array:
    """Words of each whole text; null has none."""
    return pa.array(split_words(*offsets_of(column)).per_row, pa.int64())


def repeating_weights(n: int, cycle: Sequence[float] = (5, 2, 1)) -> list[float]:
    """Weights of n sources in order, repeating."""
    return [cycle[i % len(cycle)] for i in range(n)]


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, epochs: int = EPOCHS) -> list[float]:
    """``total`` shared by weight; none above ``epochs`` times its size, the excess shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * left > epochs * sizes[i] * weight}
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(epochs * sizes[i])
            left -= out[i]
        free -= full
    return out


def min_cost_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], epochs: int = EPOCHS) -> list[dict[int, int]]:
    """Words of each pattern given to each of its sources, at least cost of repetition.

    A pattern lists its sources and its words. Its first epoch costs nothing a
    word, the second 1, the third 2. Shortest augmenting paths in the residual
    graph: of the flows that fill the quotas as far as can be, one of least cost.
    """
    sink = 1 + len(patterns) + len(quotas)
    arcs: list[list] = []
    leaving: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            leaving[x].append(len(arcs))
            arcs.append([y, c, w])
        return len(arcs) - 2

    given: list[dict[int, int]] = []
    for p, (sources, size) in enumerate(patterns):
        for epoch in range(epochs):
            arc(0, 1 + p, size, epoch)
        given.append({s: arc(1 + p, 1 + len(patterns) + s, epochs * size, 0) for s in sources})
    for s, quota in enumerate(quotas):
        arc(1 + len(patterns) + s, sink, quota, 0)
    while True:
        cost, by = [math.inf] * (sink + 1), [-1] * (sink + 1)
        cost[0], queue, queued = 0, deque([0]), {0}
        while queue:
            at = queue.popleft()
            queued.discard(at)
            for k in leaving[at]:
                to, capacity, w = arcs[k]
                if capacity > 0 and cost[at] + w < cost[to]:
                    cost[to], by[to] = cost[at] + w, k
                    if to not in queued:
                        queued.add(to)
                        queue.append(to)
        if cost[sink] == math.inf:
            return [{s: arcs[k ^ 1][1] for s, k in d.items()} for d in given]
        path, at = [], sink
        while at:
            path.append(by[at])
            at = arcs[by[at] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount


def routed(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], epochs: int = EPOCHS) -> list[dict[int, int]]:
    """As ``min_cost_flow``; a source that no pattern shares has no choice and fills its quota from its own words."""
    shared = {s for sources, _ in patterns if len(sources) > 1 for s in sources}
    out = [{s: min(quotas[s], epochs * size) for s in sources if s not in shared} for sources, size in patterns]
    tied = [i for i, (sources, _) in enumerate(patterns) if shared.intersection(sources)]
    if len(tied) > FLOW_PATTERNS:
        raise ValueError(f"{len(tied)} membership patterns of overlapping sources are more than {FLOW_PATTERNS}")
    for i, given in zip(tied, min_cost_flow([patterns[i] for i in tied], quotas, epochs), strict=True):
        out[i] = given
    return out


def _name(source) -> F.Column:
    """A source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix(
    docs: DataFrame,
    sources,
    share: float = SHARE,
    epochs: int = EPOCHS,
    weigh: Callable[[int], Sequence[float]] = repeating_weights,
    seed: int = SEED,
    seeded_by: Sequence[str] = ("doc_id", "text"),
) -> DataFrame:
    """``doc_id, size, sources, taken, takes`` per row, and with one source each ``source_size, target``.

    ``sources`` is an array column: the sources a row of ``docs(doc_id, text, ...)``
    belongs to; null is a source of its own and sorts last. Documents are summed by
    membership pattern. The driver sees one row per source and pattern, never a
    document, and routes each pattern's words to the quotas of its sources, by a flow
    where sources overlap. Then
    each pattern's words lie on a tape in seeded order, once per epoch, and the
    flow takes a piece of the tape for each source: whole documents, but for one
    cut at a word at each end of a piece. ``taken`` is at most ``epochs`` times
    ``size``. The seeded order is that of a hash of ``seeded_by``. A null or wordless
    text has size 0 and takes 0; repeated rows are documents of their own, one after
    the other in that order; rows without id are told apart by text; an empty table
    gives an empty result. More than ``FLOW_PATTERNS`` patterns of overlapping sources
    are an error.
    """
    spark = docs.sparkSession
    keys = F.array_sort(F.array_distinct(F.transform(sources, _name)))
    place = F.xxhash64(F.lit(seed), *seeded_by).alias("place")
    sized = checkpointed(docs.select("doc_id", keys.alias("sources"), word_count("text").alias("size"), place))
    sums = sized.groupBy("sources").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    names = sorted({s for r in sums for s in r.sources}, key=lambda s: (s == "null", s))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in sums:
        for s in r.sources:
            sizes[at[s]] += r.words
    wanted = targets(sizes, weigh(len(names)), share * sum(r.words for r in sums), epochs)
    patterns = [([at[s] for s in r.sources], r.words) for r in sorted(sums, key=lambda r: r.sources)]
    flow = routed(patterns, [math.floor(t) for t in wanted], epochs)
    pieces = []
    for (members, words), given in zip(patterns, flow, strict=True):
        cut = np.cumsum([0, *(given[s] for s in members)])
        tape = [(names[s], int(a), int(b)) for s, a, b in zip(members, cut[:-1], cut[1:], strict=True)]
        pieces.append(([names[s] for s in members], words, tape))
    kind = "sources array<string>, words long, tape array<struct<source: string, low: long, high: long>>"
    plan = spark.createDataFrame(pieces, kind)
    stated = spark.createDataFrame(list(zip(([n] for n in names), sizes, wanted, strict=True)), "sources array<string>, source_size long, target double")

    buckets = max(1, math.ceil(sum(r.rows for r in sums) / BUCKET_ROWS))
    spread = sized.withColumn("bucket", F.pmod("place", F.lit(buckets)))
    before = Window.partitionBy("sources").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = spread.groupBy("sources", "bucket").agg(F.sum("size").alias("inside"))
    filled = filled.select("sources", "bucket", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sources", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(filled, ["sources", "bucket"]).join(plan, "sources").join(stated, "sources", "left")
    begin = F.col("offset") + F.col("inner")

    def taken(piece):
        parts = [F.greatest(F.lit(0), F.least(piece.high, begin + F.col("size") + F.col("words") * e) - F.greatest(piece.low, begin + F.col("words") * e)) for e in range(epochs)]
        return F.struct(piece.source.alias("source"), sum(parts[1:], parts[0]).alias("words"))

    takes = placed.withColumn("takes", F.transform("tape", taken))
    total = F.aggregate("takes", F.lit(0).cast("long"), lambda x, t: x + t.words)
    return takes.select("doc_id", "size", "sources", "source_size", "target", total.alias("taken"), "takes")
