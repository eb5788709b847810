"""A training corpus from raw documents, in stages that each call one operator.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of ``documents``; the last one adds what the mix takes. A stage sees all
that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garoa.llm import decontaminate, language, mixing, near_dedup, substring
from garoa.llm.shared import shared_folder, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without text or letters go."""
    model = language.fit(docs.where(~language.held_out()))
    name = f"language_{uuid.uuid4().hex}"
    return language.with_language(docs, model, name).where(F.col(name).lang_pred != language.UNKNOWN).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of least id, rows without id last.

    Rows are numbered as they are read, so ``docs`` is a stored table; repeated
    rows, and rows of one id or of none, are rows of their own.
    """
    row, first = uuid.uuid4().hex, uuid.uuid4().hex
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    groups = near_dedup.near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    ranked = numbered.select(row, "doc_id").join(groups.hint("merge"), row)
    kept = ranked.groupBy("component_id").agg(F.min(order).alias(first)).select(F.col(first)[row].alias(row))
    return numbered.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that older ones have; those of which nothing is left go.

    A document that loses nothing keeps its text as it is.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias(uuid.uuid4().hex), *others).alias("rest")
    cut = substring.remove_repeats(docs.select("doc_id", "text", rest), ("doc_id", "text", "rest"))
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    lost = F.col("n_removed") > 0
    now = {c: F.col("rest")[c] for c in others} | {"doc_id": F.col("doc_id")}
    now["text"] = F.when(lost, F.col("kept")).otherwise(F.col("text"))
    if "n_chars" in others:
        size = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        now["n_chars"] = F.when(lost, size).otherwise(now["n_chars"])
    return cut.select(*[now[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; texts that are null or too short for one stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``taken``, the words it takes of each, repeats counted.

    Rows are numbered as they are read, so ``docs`` is a stored table, and each
    row has its own words; their order in the mix is that of their contents.
    """
    row, words, mark = uuid.uuid4().hex, uuid.uuid4().hex, uuid.uuid4().hex
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    marked = numbered.select(F.col(row).alias("doc_id"), "text", "source", F.xxhash64("doc_id", "text", "source").alias(mark))
    chosen = mixing.mix(marked, F.array("source"), seeded_by=(mark,))
    chosen = chosen.where(F.col("taken") > 0).select(F.col("doc_id").alias(row), F.col("taken").alias(words))
    kept = [c for c in docs.columns if c != "taken"]
    return numbered.join(chosen.hint("merge"), row).select(*kept, F.col(words).alias("taken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near_duplicates", one_of_near_copies),
    ("repeated_passages", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Seeded hashes and a trained classifier are not to be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
