"""Result runs published as versions: a reader sees a run whole, old or new, never half written.

Rows go to a version folder of their own. Then one small file of the manifest says which
runs the version holds and whether it replaces them or adds to them. A write that fails
leaves a version without a line in the manifest, which no reader looks at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garoa.errors import ValidationError
from garoa.sinks.tables import clustered

#: Live pairs of run and version that a reader broadcasts, once counted; more of them are joined plainly.
BROADCAST_PAIRS = 100_000
_MANIFEST = "execucao_id string, version string, seq long, replaces boolean"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published lines, also of a table that has none yet."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def live_versions(spark: SparkSession, path: str) -> DataFrame:
    """``execucao_id, version``: what each run consists of since it was last replaced."""
    lines = _manifest(spark, path)
    order = F.struct("seq", "version")
    last = lines.filter("replaces").groupBy("execucao_id").agg(F.max(order).alias("last"))
    current = order >= F.coalesce("last", F.struct(F.lit(0).cast("long").alias("seq"), F.lit("").alias("version")))
    return lines.join(last, "execucao_id", "left").filter(current).select("execucao_id", "version").distinct()


def publish_runs(df: DataFrame, path: str, replace: bool = True, runs: tuple[str, ...] = ()) -> None:
    """Publish the runs of ``df``, and those named in ``runs`` even if they have no rows.

    With ``replace`` they take the place of what the runs held; otherwise they
    are added to it. All runs of one call change together, by one file. Rows
    without a run cannot be replaced and are refused before anything is
    published. Of two writers that replace a run at once, one wins whole.
    """
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex}"
    folder = f"{path}/data/version={version}"
    clustered(df).write.mode("errorifexists").parquet(folder)
    names = spark.read.schema(df.schema).parquet(folder).select("execucao_id").distinct()
    if not names.filter("execucao_id IS NULL").isEmpty():
        raise ValidationError("a result row has no execucao_id")
    if runs:
        names = names.union(spark.createDataFrame([(r,) for r in runs], "execucao_id string")).distinct()
    [(seq,)] = _manifest(spark, path).agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).head(1)
    line = names.select("execucao_id", F.lit(version).alias("version"), F.lit(seq).cast("long").alias("seq"), F.lit(replace).alias("replaces"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The published rows, in the columns of ``schema``; none where nothing is published.

    Up to ``BROADCAST_PAIRS`` live pairs are broadcast, which prunes all folders
    but theirs before the scan; more are joined plainly, with the same rows.
    """
    try:
        rows = spark.read.schema(f"{schema}, version string").parquet(f"{path}/data")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    columns = [c for c in rows.columns if c != "version"]
    live = live_versions(spark, path)
    [(pairs,)] = live.agg(F.count(F.lit(1))).head(1)
    live = F.broadcast(live) if pairs <= BROADCAST_PAIRS else live
    return rows.join(live, ["execucao_id", "version"], "left_semi").select(*columns)


def stale_versions(spark: SparkSession, path: str) -> DataFrame:
    """``version``: folders that no run consists of any more, for the caller to delete once no reader uses them."""
    return _manifest(spark, path).select("version").distinct().join(live_versions(spark, path), "version", "left_anti")
