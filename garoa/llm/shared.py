"""Reading tables, shared storage and byte-bounded Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one; elsewhere a
    missing setting is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and where each row begins; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold about ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = offsets_of(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def arrow_batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    """A record batch of named columns."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def row_udf(kind: T.DataType, limit: int = BATCH_BYTES) -> Callable:
    """An Arrow function of one text column; it works on slices of about ``limit`` bytes."""

    def wrap(fn: Callable[[pa.Array], pa.Array]) -> Callable:
        @F.arrow_udf(kind)
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                batch = pa.RecordBatch.from_arrays([column], names=["text"])
                parts = [fn(piece.column(0)) for piece in by_bytes([batch], limit=limit)]
                yield pa.concat_arrays(parts) if parts else fn(column)

        return run

    return wrap
