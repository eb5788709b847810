"""Decide on a broadcast from a counted size, never from hope."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: A broadcast table holds at most so many bytes, as estimated from its counted rows and text.
BROADCAST_BYTES = 128 << 20
_VALUE_BYTES = 16
#: Rows of one key that one task may take as they are; beyond it they are combined before they move.
ROWS_OF_KEY = 2_000_000


_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Keep a reduced table that a plan reads more than once, until ``release``.

    Blocks lost with an executor are recomputed from lineage.
    """
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


def release() -> None:
    """Free what was kept, once the results that need it are written; later uses compute it again."""
    while _KEPT:
        _KEPT.pop().unpersist()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def detached(df: DataFrame) -> DataFrame:
    """A reduced table without its lineage, stored in the shared folder, so that no plan computes it again.

    Plans that read a table twice may not recognise what is kept of it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def listed(df: DataFrame, most: int) -> list[Row] | None:
    """Rows of a reduced table, once they are counted to be no more than ``most``; nothing is read beyond it.

    For names that become part of a plan, such as a filter of the scan.
    """
    [(rows,)] = df.agg(F.count(F.lit(1))).head(1)
    if rows > most:
        return None
    [(values,)] = df.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).head(1)
    return values


def spread(df: DataFrame) -> DataFrame:
    """Spread small rows that are costly to work on over all shuffle partitions.

    Adaptive execution sizes tasks by bytes and would leave such rows to a few.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt out by a key, for aggregates and windows by this key and more that then need no exchange of their own.

    Rows of a key are not combined before they move. Where counting finds a key
    with more than ``ROWS_OF_KEY`` rows, the frame is returned as it is, and its
    aggregates combine first. Rows without a key are not counted: joins drop them.
    """
    own = df.filter(F.col(key[0]).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    return df.repartition(*key) if own.filter(F.col("_rows") > ROWS_OF_KEY).isEmpty() else df


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hint a broadcast when a table is measured at no more than ``BROADCAST_BYTES``.

    ``max_rows`` is a further bound, for tables that the plan multiplies later.

    The planner guesses the size of an aggregate or a join from its inputs, so a
    handful of rows reduced from a huge grid would otherwise be shuffle-joined.
    The table is kept so that the count adds no second pass, and counted by partial sums. Above the bound the
    plain join stays and the planner picks its strategy.
    """
    kept = keep(df)
    most = BROADCAST_BYTES // (_VALUE_BYTES * (len(df.columns) + 1))
    most = most if max_rows is None else min(most, max_rows)
    wide = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, kind in df.dtypes if kind == "string" or "<" in kind]
    text = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0))
    [(rows, size)] = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).head(1)
    return F.broadcast(kept) if rows <= most and size <= BROADCAST_BYTES else kept
