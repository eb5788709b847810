"""Language of whole texts by a string kernel.

Two texts are alike by the blended spectrum of byte n-grams present in both,
normalised by their numbers. A bounded sample gives Nyström landmarks and a
one-versus-rest kernel ridge regression; scoring is two matrix products a batch.
A long text is scored in parts, whose scores are averaged by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from garoa.llm.shared import by_bytes, offsets_of, row_udf

BITS = 14
GRAMS = (1, 2, 3, 4)
LANDMARKS = 128
#: Bound of the labelled sample: rows of a language, and in all.
SAMPLE_OF_LANGUAGE = 500
SAMPLE = 10_000
RIDGE = 1e-3
UNKNOWN = "und"
#: Bytes after which a longer text is cut, at white space; its parts are scored each and weigh by their bytes.
#: A part of natural text holds far fewer distinct n-grams than there are slots.
PART_BYTES = 6_000
_ROWS = 256


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the parts of each row, and the row of each part; a short or empty row is one part."""
    bounds, rows = [np.zeros(1, np.int64)], []
    for row in range(len(offsets) - 1):
        begin, end = int(offsets[row]), int(offsets[row + 1])
        cuts = []
        while end - begin > PART_BYTES * 3 // 2:
            low = begin + PART_BYTES
            near = data[low : low + PART_BYTES // 2]
            places = np.flatnonzero((near == 32) | (near == 10))
            if not len(places):
                places = np.flatnonzero((near & 0xC0) != 0x80)
            begin = low + int(places[0])
            cuts.append(begin)
        bounds.append(np.array([*cuts, end], np.int64))
        rows.append(np.full(len(cuts) + 1, row))
    return np.concatenate(bounds), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which hashed n-grams each row holds, as 0 and 1; A-Z count as a-z."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    if not len(data):
        return out
    code = data.astype(np.uint32)
    code[(code >= 65) & (code <= 90)] += np.uint32(32)
    row = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    gram = np.zeros(len(data), np.uint32)
    for size in range(1, max(GRAMS) + 1):
        gram[: len(data) - size + 1] |= code[size - 1 :] << np.uint32(8 * (size - 1))
        if size in GRAMS:
            slot = (gram * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
            whole = left >= size
            out.reshape(-1)[row[whole] + slot[whole]] = 1
    return out


@dataclass
class Model:
    """Landmarks as packed presence bits, and a weight per landmark and language."""

    bits: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def landmarks(self) -> np.ndarray:
        full = np.unpackbits(self.bits, axis=1).astype(np.float32)
        return _unit(full)

    def scores(self, rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        """A value per row and language, 0 to 1."""
        return np.clip(((_unit(rows) @ landmarks.T) @ self.weights + 1) / 2, 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram bits of each text; of a longer one, those of a part that its id names."""
    for batch in by_bytes(batches, limit=1 << 20):
        data, offsets = offsets_of(batch.column("text"))
        bounds, rows = parts(data, offsets)
        first = np.searchsorted(rows, np.arange(batch.num_rows))
        many = np.bincount(rows, minlength=batch.num_rows)
        ids = batch.column("doc_id").to_numpy().astype(np.int64)
        part = first + (ids % many)
        lengths = bounds[part + 1] - bounds[part]
        own = np.append(0, np.cumsum(lengths))
        take = np.repeat(bounds[part] - own[:-1], lengths) + np.arange(own[-1])
        bits = np.packbits(presence(data[take], own).astype(bool), axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array([x.tobytes() for x in bits], pa.binary())],
            names=["doc_id", "lang", "bits"],
        )


def fit(labelled: DataFrame) -> Model:
    """A model of ``labelled(doc_id, text, lang)``; rows without text, language or id are not used.

    The sample is bounded by ``SAMPLE_OF_LANGUAGE`` and ``SAMPLE`` pairs of id and
    language, chosen by a seeded hash; however many rows have them, one of each comes to the driver, as packed
    n-gram bits of 2 kB.
    """
    usable = labelled.where("doc_id is not null and lang is not null and text is not null")
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id")]
    ranked = usable.select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("k"))
    chosen = ranked.where(F.col("k") <= SAMPLE_OF_LANGUAGE).orderBy("k", *order).limit(SAMPLE)
    pairs = F.broadcast(chosen.select("doc_id", "lang").distinct())
    picked = usable.select("doc_id", "lang", "text").join(pairs, ["doc_id", "lang"])
    made = picked.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(_features, "doc_id long, lang string, bits binary")
    rows = made.groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.bits)))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return Model(np.zeros((0, (1 << BITS) // 8), np.uint8), np.zeros((0, 0), np.float32), [])
    bits = np.stack([np.frombuffer(r.bits, np.uint8) for r in rows])
    truth = np.array([languages.index(r.lang) for r in rows])
    target = 2 * (truth[:, None] == np.arange(len(languages))) - 1.0
    pick = np.random.default_rng(0).permutation(len(rows))[:LANDMARKS]
    model = Model(bits[np.sort(pick)], np.zeros(0), languages)
    landmarks = model.landmarks()
    near = np.concatenate([_unit(np.unpackbits(b, axis=1).astype(np.float32)) @ landmarks.T for b in np.array_split(bits, max(1, len(bits) // _ROWS))])
    value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    mapped = near @ root
    weight = 1 / np.bincount(truth, minlength=len(languages))[truth]
    gram = mapped.T @ (mapped * weight[:, None]) + RIDGE * np.eye(mapped.shape[1])
    model.weights = (root @ np.linalg.solve(gram, mapped.T @ (target * weight[:, None]))).astype(np.float32)
    return model


def language_of(model: Model):
    """An Arrow function of a text column: ``struct<lang_pred, score>``, from the text alone."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    ready: list[np.ndarray] = []

    @row_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), 2 << 20)
    def predict(column: pa.Array) -> pa.Array:
        n = len(column)
        if not model.languages:
            return pa.array([{"lang_pred": UNKNOWN, "score": 0.0}] * n, kind)
        if not ready:
            ready.append(model.landmarks())
        data, offsets = offsets_of(column)
        bounds, rows = parts(data, offsets)
        total = np.zeros((n, len(model.languages)))
        for begin in range(0, len(rows), _ROWS):
            own = bounds[begin : begin + _ROWS + 1]
            size = np.diff(own)
            values = model.scores(presence(data[own[0] : own[-1]], own - own[0]), ready[0])
            np.add.at(total, rows[begin : begin + _ROWS], values * np.maximum(size, 1)[:, None])
        total /= np.maximum(np.diff(offsets), 1)[:, None]
        best, score = total.argmax(1), np.clip(total.max(1), 0, 1)
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(score)], fields=list(kind))

    return predict


def held_out(doc_id: str = "doc_id"):
    """Documents never learned from: crc32 of the id as text, modulo 5, is 0. False without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def with_language(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """``docs`` and a struct ``name`` of ``lang_pred`` and ``score``; ``und`` and 0 without a letter."""
    found = language_of(model)(F.col("text"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.withColumn(name, F.when(lettered, found).otherwise(none))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs(doc_id, text, lang, ...)``.

    The model learns from rows that are not held out and have a language.
    A null text, or one without a letter, is ``und`` with score 0; so is every
    text when nothing can be learned. Repeated rows get equal answers; other
    columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
