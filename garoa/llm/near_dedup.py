"""Near duplicates by a chosen-path similarity join over word shingles.

A document is the set of its distinct five-word shingles, embedded as 64 minwise
tokens. Each tree chooses tokens at its root and sends a document to one child
per chosen token, named by the token's value; a child that is still large
chooses further tokens by its own path. Two sets of Jaccard likeness 0.75 stay
together at a node with 2 chosen tokens with probability 0.94, down three levels
with 0.90, in at least one of 4 independent trees with 0.9999. Small nodes are
compared exhaustively on their tokens; what this connects, and nodes that no
level divides, are the groups within which full sets are compared, so every link
is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garoa.llm.arrow_words import distinct_by_row, mix, shingles, split_words, word_hashes
from garoa.llm.components import components
from garoa.llm.shared import arrow_batch, by_bytes, checkpointed, offsets_of

SHINGLE = 5
SHARE = 75
TOKENS = 64
TREES = 4
CHOSEN = 2
DEPTH = 3
SMALL_NODE = 100
#: Tokens that must agree for a pair to be confirmed on full sets: half of them, which lies 4.6
#: standard deviations below what likeness 0.75 gives.
AGREE = TOKENS // 2
CHUNK = 256

_MULTIPLY = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, 1001 + TOKENS, dtype=np.uint64))


def _minwise(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Minwise tokens of each row's shingles."""
    out = np.zeros((n, TOKENS), np.uint32)
    if len(values):
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        has = rows[begins]
        for t in range(TOKENS):
            out[has, t] = np.minimum.reduceat(((values * _MULTIPLY[t] + _ADD[t]) >> np.uint64(32)).astype(np.uint32), begins)
    return out


def _set_hash(values: np.ndarray, rows: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each row's set of shingles, whatever their order."""
    out = np.zeros(n, np.uint64)
    if len(values):
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[begins]] = np.add.reduceat(mix(values ^ mix(np.full(1, salt, np.uint64))), begins)
    return mix(out)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        words = split_words(*offsets_of(batch.column("text")), lower=True)
        hashes = word_hashes(words)
        values, rows = distinct_by_row(*shingles(hashes, words.first, SHINGLE))
        tokens = _minwise(values, rows, batch.num_rows).view(np.int32).ravel()
        lists = pa.ListArray.from_arrays(np.arange(0, len(tokens) + 1, TOKENS, dtype=np.int32), tokens)
        yield arrow_batch(
            {
                "doc_id": batch.column("doc_id"),
                "n_shingles": np.bincount(rows, minlength=batch.num_rows),
                "high": _set_hash(values, rows, batch.num_rows, 1).view(np.int64),
                "low": _set_hash(values, rows, batch.num_rows, 2).view(np.int64),
                "tokens": lists,
            }
        )


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: set size, two hashes of the set, and minwise tokens."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketch, "doc_id long, n_shingles long, high long, low long, tokens array<int>"
    )


def _children(path: Column, level: int) -> Column:
    """Chosen tokens of a node as ``struct(path)`` of its children; the root chooses per tree."""
    if level == 0:
        picks = [(F.lit(i), i // CHOSEN) for i in range(TREES * CHOSEN)]
    else:
        rest = TOKENS - TREES * CHOSEN
        picks = [(F.lit(TREES * CHOSEN) + F.pmod(F.xxhash64(path, F.lit(c)), F.lit(rest)).cast("int"), c) for c in range(CHOSEN)]
    return F.array(*[F.xxhash64(path, F.lit(level), F.lit(tree), at, F.element_at("tokens", at + 1)) for at, tree in picks])


def _node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of a small node whose tokens agree often enough, reduced to links that connect the same."""
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for members in batch.column("members"):
            part = members.values
            ids, sizes = (part.field(c).to_numpy() for c in ("id", "n"))
            tokens = np.asarray(part.field("tokens").flatten()).reshape(-1, TOKENS)
            for r in range(len(ids) - 1):
                size = sizes[r + 1 :]
                hit = (tokens[r + 1 :] == tokens[r]).sum(1) >= AGREE
                hit &= 100 * np.minimum(size, sizes[r]) >= SHARE * np.maximum(size, sizes[r])
                b.append(ids[r + 1 :][hit])
                a.append(np.full(len(b[-1]), ids[r]))
        yield arrow_batch(_forest(np.concatenate(a), np.concatenate(b)))


def _forest(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Links of every end to the least id it is connected with: as connected, and linear in number."""
    ids, codes = np.unique(np.append(a, b), return_inverse=True)
    label = np.arange(len(ids))
    x, y = codes[: len(a)], codes[len(a) :]
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(ids))
    return {"a": ids[label[keep]], "b": ids[keep]}


def likely_links(sketched: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all documents the trees find likely alike.

    ``sketched(id, n, tokens)`` has a row per distinct set. Small nodes of the
    same members count once and are compared exhaustively. Large ones branch on,
    each by its own path, also if others have the same members; those still large at the last level connect all members, to
    be told apart on full sets. Members of a node are counted, never gathered,
    unless it is small.
    """
    nodes = sketched.select("id", "tokens", F.explode(_children(F.lit(0), 0)).alias("node"))
    small = []
    for level in range(1, DEPTH + 1):
        same = [F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min("id").alias("pivot"), F.max("id").alias("top")]
        own = F.when(F.col("m") > SMALL_NODE, F.col("node")).alias("own")
        sizes = nodes.groupBy("node").agg(*same).where("m > 1").groupBy("m", "mark", "pivot", "top", own).agg(F.min("node").alias("node"))
        shared = checkpointed(nodes.select("node", "id").join(sizes.select("node", "m", "pivot").hint("merge"), "node"))
        small.append(shared.where(F.col("m") <= SMALL_NODE).select("node", "id"))
        large = shared.where(F.col("m") > SMALL_NODE)
        if level == DEPTH or large.isEmpty():
            break
        held = large.select("node", "id").join(sketched.hint("merge"), "id")
        nodes = held.select("id", "tokens", F.explode(_children(F.col("node"), level)).alias("node"))
    members = reduce(DataFrame.union, small).join(sketched.hint("merge"), "id")
    gathered = members.groupBy("node").agg(F.collect_list(F.struct("id", "n", "tokens")).alias("members"))
    found = gathered.select("members").mapInArrow(_node_links, "a long, b long")
    dense = large.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    return checkpointed(found.union(dense).distinct())


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = split_words(*offsets_of(batch.column("text")), lower=True)
    return distinct_by_row(*shingles(word_hashes(words), words.first, SHINGLE))


def _exact(ids1: np.ndarray, set1, ids2: np.ndarray, set2) -> dict[str, np.ndarray]:
    """Links between rows of two groups, on their full sets."""
    (v1, r1), (v2, r2) = set1, set2
    shared = np.intersect1d(v1, v2)
    n1, n2 = np.bincount(r1, minlength=len(ids1)), np.bincount(r2, minlength=len(ids2))
    both = np.zeros((len(ids1), len(ids2)), np.float32)
    at1, at2 = np.searchsorted(shared, v1), np.searchsorted(shared, v2)
    width = 4096
    for low in range(0, len(shared), width):
        x = np.zeros((len(ids1), width), np.float32)
        y = np.zeros((len(ids2), width), np.float32)
        for at, v, r, m in ((at1, v1, r1, x), (at2, v2, r2, y)):
            use = (at >= low) & (at < min(low + width, len(shared)))
            use[use] = shared[at[use]] == v[use]
            m[r[use], at[use] - low] = 1
        both += x @ y.T
    union = n1[:, None] + n2[None, :] - both
    i, j = np.nonzero((100 * both >= SHARE * union) & (union > 0) & (ids1[:, None] != ids2[None, :]))
    return _forest(ids1[i], ids2[j])


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))


def _confirm_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links inside each group; rows come sorted by group, and a group is at most one chunk."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        rest = piece if rest is None else pa.concat_tables([rest, piece])
        edges = _runs(rest.column("grp").to_numpy())
        if len(edges) > 2:
            yield from _confirm(rest.slice(0, edges[-2]))
            rest = rest.slice(edges[-2])
    if rest is not None:
        yield from _confirm(rest)


def _confirm(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    whole = rows.combine_chunks().to_batches()[0]
    edges = _runs(whole.column("grp").to_numpy())
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        group = whole.slice(begin, end - begin)
        ids, found = group.column("id").to_numpy(), _sets(group)
        yield arrow_batch(_exact(ids, found, ids, found))


def _confirm_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links between two chunks of documents."""
    for batch in batches:
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            sides = []
            for side in (left.values, right.values):
                ids = side.field("id").to_numpy()
                sides += [ids, _sets(pa.RecordBatch.from_arrays([side.field("text")], names=["text"]))]
            yield arrow_batch(_exact(*sides))


def _chunk_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Exact links between documents of the same ``grp`` on both sides, chunk against chunk.

    Each left chunk goes to every right chunk of its group, so a large group is
    spread over as many keys as it has chunks.
    """
    packed = [
        df.groupBy("grp", F.pmod(F.xxhash64("id"), "chunks").alias("chunk")).agg(
            F.collect_list(F.struct("id", "text")).alias(name), F.first("chunks").alias("chunks")
        )
        for df, name in ((left, "left"), (right, "right"))
    ]
    sent = packed[0].select("grp", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    pairs = sent.join(packed[1].select("grp", "chunk", "right").hint("merge"), ["grp", "chunk"])
    return pairs.select("left", "right").mapInArrow(_confirm_pairs, "a long, b long")


def confirmed(likely: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, component`` of documents linked by likeness 0.75 on full sets, inside likely groups.

    A group of at most one chunk is compared in one task. A larger group is
    compared with one chunk of it first, which is linear; only documents that
    this leaves outside the group's largest part are compared with all others.
    """
    groups = components(likely).withColumnRenamed("component", "grp")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"))
    members = groups.join(sizes.hint("merge"), "grp")
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null")
    texts = checkpointed(texts.join(members.hint("merge"), "id").withColumn("chunks", F.ceil(F.col("m") / CHUNK)))
    one = texts.where("chunks = 1").select("grp", "id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = one.repartition(parts, "grp").sortWithinPartitions("grp", "id").mapInArrow(_confirm_groups, "a long, b long")
    small = small.select(F.col("b").alias("id"), F.col("a").alias("component"))
    many = texts.where("chunks > 1")
    if many.isEmpty():
        return checkpointed(small)
    probe = many.where(F.pmod(F.xxhash64("id"), "chunks") == 0)
    links = checkpointed(_chunk_pairs(probe, many))
    label = many.select("grp", "id").distinct().join(components(links).hint("merge"), "id", "left")
    label = label.withColumn("component", F.coalesce("component", "id"))
    parts_of = label.groupBy("grp", "component").agg(F.count("*").alias("k"))
    largest = parts_of.groupBy("grp").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
    outside = label.join(largest.hint("merge"), "grp").where("component <> largest").select("id")
    rest = many.join(outside.hint("merge"), "id", "left_semi")
    links = checkpointed(links.union(_chunk_pairs(rest, many)))
    return checkpointed(small.union(components(links)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Equal sets
    are one class from the start, so copies cost one narrow row each.
    A null or wordless text has an empty set and is linked with nothing. Rows of
    one ``doc_id`` count as one document, linked by any of its texts. A row
    without ``doc_id`` is linked with nothing: null component, kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    sketched = checkpointed(sketches(docs))
    filled = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("high", "low").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens")
    )
    classes = checkpointed(classes)
    labels = confirmed(likely_links(classes.select("id", "n", "tokens")), docs)
    classed = filled.select("doc_id", "high", "low").join(classes.select("high", "low", "id").hint("merge"), ["high", "low"])
    named = classed.join(labels.hint("merge"), "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    each = checkpointed(named.groupBy("doc_id").agg(F.min("component").alias("component"), F.max("component").alias("other")))
    split = each.where("component <> other")
    if not split.isEmpty():
        merged = checkpointed(named.select(F.col("component").alias("a"), F.col("doc_id").alias("b")))
        each = components(merged).select(F.col("id").alias("doc_id"), "component")
    out = sketched.select("doc_id", "n_shingles").join(each.select("doc_id", "component").hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
