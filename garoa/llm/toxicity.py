"""Toxicity of whole texts: boosted trees over a few dense rates, then isotonic calibration.

A text becomes rates of lexicon words and stems, their greatest density in one
passage, their nearness to the second person, capitals, punctuation and
obfuscated spelling. The lexicon is learned from labelled texts: words, and stems
of four and five characters, that toxic texts hold significantly more often, in
several different contexts, so that a passage that is copied many times teaches
nothing. Each labelled text is described by a lexicon of the other folds, and
the trees learn from these. A part of the labelled texts is kept from the trees and
calibrates their margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garoa.llm.arrow_words import Words, split_words, word_hashes
from garoa.llm.shared import arrow_batch, by_bytes, checkpointed, offsets_of, row_udf

#: Bound of the labelled sample: rows of a label.
SAMPLE_OF_LABEL = 5_000
FOLDS = 3
#: Units of a lexicon, at most; how significant they must be (signed root of a log-likelihood ratio), how many times as frequent, in how many contexts.
LEXICON, SIGNIFICANT, LIFT, CONTEXTS = 4_000, 4.0, 3.0, 4
STEMS = (4, 5)
#: Words of the passage in which lexicon words are densest, and to a second person.
PASSAGE, NEAR = 32, 3
TREES, TREE_DEPTH = 30, 3
THRESHOLD = 0.3
#: Bytes of text that are looked at together; a longer text is cut at white space and its counts are added up.
BLOCK_BYTES = 1 << 20
_SEED = 12

# Second persons of four languages, and common insults.
SECOND_PERSON = (
    "you your yours yourself ye u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vos su"
).split()
INSULTS = (
    "idiot idiots moron morons stupid dumb imbecile loser losers scum trash garbage filth filthy pathetic disgusting worthless "
    "clown liar jerk fool freak creep pig bastard crap shit fuck fucking bitch asshole dickhead retard hate kill die "
    "idioten dumm dummkopf trottel arschloch scheiße schwein hurensohn abschaum versager widerlich "
    "idiote imbécile con connard connasse salaud salope merde débile pourriture ordure dégoûtant "
    "idiota imbécil estúpido estúpida tonto basura mierda cabrón puta pendejo asqueroso gilipollas"
).split()
#: Characters that stand for letters, and ones that are put between letters.
_LEET = bytes.maketrans(b"013457@$!|+", b"oieastasilt")
_BETWEEN = b"*._-~'`^#"

FEATURES = 16

_ASCII_PUNCT = np.zeros(256, bool)
_ASCII_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of single words."""
    data, offsets = offsets_of(pa.array(words, pa.string()))
    return np.unique(word_hashes(split_words(data, offsets)))


_SECOND, _INSULTS = _hashes(SECOND_PERSON), _hashes(INSULTS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _stem_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` characters of each word, and which words are longer than that."""
    begins = np.flatnonzero((words.data & 0xC0) != 0x80)
    at = np.searchsorted(begins, words.starts) + size
    ends = np.append(begins, len(words.data))[np.minimum(at, len(begins))]
    longer = ends < words.ends
    ends = np.minimum(ends, words.ends)
    edge = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(edge, ends, 1)
    np.add.at(edge, words.ends, -1)
    data = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, np.uint8(32), words.data)
    return word_hashes(Words(data, words.starts, ends, words.first)), longer


def _plain_words(lower: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of lower-case texts, where ASCII punctuation also parts words."""
    return split_words(np.where(_ASCII_PUNCT[lower], np.uint8(32), lower), offsets)


def _units(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words and stems, and which words have them; stems are told apart from words by their length."""
    hashes = word_hashes(words)
    out = [(hashes, np.ones(len(hashes), bool))]
    for size in STEMS:
        stem, longer = _stem_hashes(words, size)
        out.append((stem * np.uint64(2 * size + 1), longer))
    return out


@dataclass
class Lexicon:
    """Sorted unit hashes; words and stems are hashed apart."""

    units: np.ndarray

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words are lexicon words, and which have a lexicon stem."""
        (hashes, _), *stems = _units(words)
        stem = np.zeros(len(hashes), bool)
        for values, longer in stems:
            stem |= longer & _among(values, self.units)
        return _among(hashes, self.units), stem


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each row."""
    return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[first])


def _obfuscated(raw: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Words that mix letters with digits or signs inside, and of these the ones that read as lexicon words or insults."""
    letter = np.zeros(len(raw.data) + 1, np.int64)
    is_letter = ((raw.data | 32) >= 97) & ((raw.data | 32) <= 122) | (raw.data >= 128)
    letter[1:] = np.cumsum(is_letter)
    begins, ends = raw.starts.copy(), raw.ends.copy()
    for _ in range(3):
        more = (ends - begins > 1) & np.isin(raw.data[ends - 1], np.frombuffer(b".,;:?!\"')", np.uint8))
        ends = ends - more
    inside = letter[ends] - letter[begins]
    mixed = (inside >= 1) & (inside < ends - begins) & is_letter[np.minimum(begins, len(is_letter) - 1)] if len(begins) else np.zeros(0, bool)
    mixed |= (inside >= 2) & (inside < ends - begins)
    hidden = np.zeros(len(mixed), bool)
    at = np.flatnonzero(mixed)
    if len(at):
        text = raw.data.tobytes()
        cleaned = [text[a:b].translate(_LEET, _BETWEEN) or b"x" for a, b in zip(begins[at], ends[at], strict=True)]
        sizes = np.array([len(c) for c in cleaned])
        data = np.frombuffer(b"".join(cleaned), np.uint8)
        offsets = np.append(0, np.cumsum(sizes))
        words = _plain_words(data, offsets)
        word, stem = lexicon.hits(words)
        insult = _among(word_hashes(words), _INSULTS)
        hidden[at] = _by_row(word | stem | insult, words.first) > 0
    return mixed, hidden


def _densest(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Most hits of ``PASSAGE`` consecutive words in each row."""
    total = np.append(0, np.cumsum(hit, dtype=np.int64))
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(hit))
    window = total[np.minimum(at + PASSAGE, first[rows + 1])] - total[at]
    out = np.zeros(len(first) - 1, np.int64)
    full = np.diff(first) > 0
    if full.any():
        out[full] = np.maximum.reduceat(window, first[:-1][full])
    return out


def _counts(raw: np.ndarray, lower: np.ndarray, raw_offsets: np.ndarray, lower_offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Additive counts of each text, and, last, its densest passage."""
    words, raw_words = _plain_words(lower, lower_offsets), split_words(raw, raw_offsets)
    hashes = word_hashes(words)
    word, stem = lexicon.hits(words)
    insult, second = _among(hashes, _INSULTS), _among(hashes, _SECOND)
    bad = word | stem | insult
    rows = words.rows()
    around = np.append(0, np.cumsum(second, dtype=np.int64))
    at = np.arange(len(hashes))
    first = words.first
    near = bad & (around[np.minimum(at + NEAR + 1, first[rows + 1])] > around[np.maximum(at - NEAR, first[rows])])
    capital = (raw >= 65) & (raw <= 90)
    capital[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    small = (raw >= 97) & (raw <= 122)
    inside = np.append(0, np.cumsum(capital, dtype=np.int64))
    lowers = np.append(0, np.cumsum(small, dtype=np.int64))
    a, b = raw_words.starts, raw_words.ends
    shouted = (inside[b] - inside[a] >= 3) & (lowers[b] == lowers[a])
    mark = (raw == 33) | (raw == 63)
    cry = mark.copy()
    cry[1:] &= mark[:-1]
    cry[:1] = False
    drawn = np.zeros(len(lower), bool)
    drawn[2:] = (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & (lower[2:] >= 97) & (lower[2:] <= 122)
    mixed, hidden = _obfuscated(split_words(lower, lower_offsets), lexicon)
    lower_words = split_words(lower, lower_offsets)
    single = (words.ends - words.starts) == 1
    run = single.copy()
    for k in (1, 2, 3):
        run[k:] &= single[:-k] & (rows[k:] == rows[:-k])
        run[:k] = False
    return np.stack(
        [
            words.per_row,
            _by_row(capital | small, raw_offsets),
            np.diff(raw_offsets),
            _by_row(second, first),
            _by_row(insult, first),
            _by_row(word, first),
            _by_row(stem, first),
            _by_row(near, first),
            _by_row(capital, raw_offsets),
            _by_row(shouted, raw_words.first),
            _by_row(mark, raw_offsets),
            _by_row(cry, raw_offsets),
            _by_row(mixed, lower_words.first),
            _by_row(hidden, lower_words.first),
            _by_row(run, first),
            _by_row(drawn, lower_offsets),
            _densest(bad, first),
        ],
        axis=1,
    ).astype(np.float64)


def _pieces(text: str) -> list[str]:
    """A long text cut after white space, about every ``BLOCK_BYTES`` characters."""
    out, begin = [], 0
    while len(text) - begin > BLOCK_BYTES:
        ends = [e for e in (text.find(c, begin + BLOCK_BYTES) for c in " \n") if e >= 0]
        if not ends:
            break
        out.append(text[begin : min(ends) + 1])
        begin = min(ends) + 1
    return [*out, text[begin:]]


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Dense features of each text of about one block, or of one longer text; null counts as empty."""
    column = pc.fill_null(column, "")
    if len(column) == 1 and len(text := column[0].as_py()) > BLOCK_BYTES:
        parts = [_counts_of(pa.array([piece], pa.string()), lexicon) for piece in _pieces(text)]
        counts = np.concatenate(parts)
        counts = np.append(counts[:, :-1].sum(0), counts[:, -1].max())[None]
    else:
        counts = _counts_of(column, lexicon)
    words, letters, size = (np.maximum(counts[:, i], 1) for i in range(3))
    rate = counts[:, 3:16] / words[:, None]
    rate[:, 5] = counts[:, 8] / letters
    rate[:, 7:9] = counts[:, 10:12] / size[:, None]
    rate[:, 12] = counts[:, 15] / letters
    return np.column_stack([np.log1p(counts[:, 0]), np.log1p(counts[:, 4:7].sum(1)), rate, counts[:, 16]])


def _counts_of(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    raw, raw_offsets = offsets_of(column)
    lower, lower_offsets = offsets_of(pc.utf8_lower(column))
    return _counts(raw, lower, raw_offsets, lower_offsets, lexicon)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice, unit, fold and label: texts that hold the unit, and a bitmap of the words before it."""
    for batch in by_bytes(batches, limit=4 * BLOCK_BYTES):
        words = _plain_words(*offsets_of(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))))
        hashes = word_hashes(words)
        rows = words.rows()
        before = np.append(np.uint64(0), hashes[:-1])
        if len(before):
            before[words.first[:-1][words.per_row > 0]] = 0
        context = np.left_shift(np.uint64(1), before >> np.uint64(58))
        group = (2 * batch.column("fold").to_numpy() + batch.column("toxic").to_numpy())[rows]
        for values, has in _units(words):
            order = np.lexsort((rows[has], values[has], group[has]))
            unit, of, row, bit = (x[has][order] for x in (values, group, rows, context))
            new = np.ones(len(unit), bool)
            new[1:] = (unit[1:] != unit[:-1]) | (of[1:] != of[:-1])
            heads = np.flatnonzero(new)
            if not len(heads):
                continue
            text = new.copy()
            text[1:] |= row[1:] != row[:-1]
            yield arrow_batch(
                {
                    "unit": unit[heads].view(np.int64),
                    "fold": (of[heads] >> 1).astype(np.int32),
                    "toxic": (of[heads] & 1).astype(np.int32),
                    "texts": np.add.reduceat(text, heads, dtype=np.int64),
                    "contexts": np.bitwise_or.reduceat(bit, heads).view(np.int64),
                }
            )


def _lexicons(sample: DataFrame, numbers: dict[tuple[int, int], int]) -> list[Lexicon]:
    """A lexicon of all folds but each one, and of all."""
    units = sample.mapInArrow(_unit_rows, "unit long, fold int, toxic int, texts long, contexts long")
    versions = [*range(FOLDS), -1]
    toxic = F.col("toxic") == 1
    sums, scores = [], []
    for v in versions:
        own = F.col("fold") != v
        sums += [
            F.sum(F.when(own & toxic, F.col("texts")).otherwise(0)).alias(f"a{v + 1}"),
            F.sum(F.when(own & ~toxic, F.col("texts")).otherwise(0)).alias(f"b{v + 1}"),
            F.bit_or(F.when(own & toxic, F.col("contexts")).otherwise(0)).alias(f"c{v + 1}"),
        ]
        all_toxic = sum(n for (f, t), n in numbers.items() if f != v and t == 1)
        everything = sum(n for (f, _), n in numbers.items() if f != v)
        share = min(max(all_toxic / max(everything, 1), 1e-6), 1 - 1e-6)
        a, b = F.col(f"a{v + 1}"), F.col(f"b{v + 1}")
        n = a + b
        log = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
        odds = (a + 0.5) / (b + 0.5) * ((1 - share) / share)
        root = F.sqrt(F.greatest(F.lit(0.0), 2 * (log(a, n * share) + log(b, n * (1 - share)))))
        fits = (odds >= LIFT) & (root >= SIGNIFICANT) & (F.bit_count(F.col(f"c{v + 1}")) >= CONTEXTS)
        scores.append(F.when(fits, root).alias(f"s{v + 1}"))
    scored = units.groupBy("unit").agg(*sums).select("unit", *scores)
    scored = checkpointed(scored.where(F.coalesce(*[F.col(f"s{v + 1}") for v in versions]).isNotNull()))
    out = []
    for v in versions:
        best = scored.where(F.col(f"s{v + 1}").isNotNull()).orderBy(F.desc(f"s{v + 1}"), "unit").limit(LEXICON)
        out.append(Lexicon(np.sort(np.array([r.unit for r in best.select("unit").collect()], np.int64).view(np.uint64))))
    return out


@dataclass
class Model:
    """A lexicon, trees and their calibration; without trees every text gets ``base``."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def _vectors(lexicons: list[Lexicon]):
    """An Arrow function: features of a labelled text by the lexicon of the other folds."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=BLOCK_BYTES):
            fold = batch.column("fold").to_numpy()
            out = np.zeros((batch.num_rows, FEATURES))
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                out[at] = features(batch.column("text").take(pa.array(at)), lexicons[f])
            offsets = np.arange(len(out) + 1, dtype=np.int32) * FEATURES
            rows = pa.ListArray.from_arrays(offsets, out.reshape(-1))
            yield arrow_batch({"hash": batch.column("hash"), "fold": batch.column("fold"), "toxic": batch.column("toxic"), "x": rows})

    return described


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels(doc_id, toxic)`` and their texts in ``docs(doc_id, text)``.

    At most ``SAMPLE_OF_LABEL`` labelled ids of each label are learned from,
    chosen by a seeded hash; weights give them back their labels' true share. A text
    that the sample holds more than once with a label counts once. Only counts,
    lexicon hashes and tree statistics come to the driver.
    """
    clear = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in clear.groupBy("toxic").count().collect()}
    base = totals.get(1, 0) / max(sum(totals.values()), 1)
    none = Model(Lexicon(np.zeros(0, np.uint64)), None, None, base)
    if len(totals) < 2:
        return none
    picked = [clear.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(_SEED)), "doc_id").limit(SAMPLE_OF_LABEL) for t in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))
    known = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = known.withColumn("fold", F.pmod(F.xxhash64("hash", F.lit(_SEED)), F.lit(FOLDS)).cast("int"))
    sample = checkpointed(known.select("text", "hash", "fold", "toxic"))
    numbers = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    if len({t for _, t in numbers}) < 2:
        return none
    *folds, lexicon = _lexicons(sample, numbers)
    rows = sample.mapInArrow(_vectors(folds), "hash long, fold int, toxic int, x array<double>")
    rows = rows.groupBy("hash", "toxic").agg(F.first("fold").alias("fold"), F.first("x").alias("x"))
    held = {t: sum(n for (_, u), n in numbers.items() if u == t) for t in (0, 1)}
    weight = F.when(F.col("toxic") == 1, totals[1] / held[1]).otherwise(totals[0] / held[0])
    rows = rows.orderBy(F.xxhash64("hash", F.lit(_SEED)), "hash", "toxic").limit(2 * SAMPLE_OF_LABEL)
    rows = checkpointed(rows.select("hash", "fold", F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("features"), weight.alias("weight")).coalesce(1))
    learned, kept = rows.where("fold > 0"), rows.where("fold = 0")
    if learned.select("label").distinct().count() < 2 or kept.select("label").distinct().count() < 2:
        learned = kept = rows
    trees = GBTClassifier(maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.2, seed=_SEED, weightCol="weight", minInstancesPerNode=3, checkpointInterval=-1).fit(learned)
    margins = trees.transform(kept).select("label", "weight", _margin().alias("features"))
    calibration = IsotonicRegression(weightCol="weight").fit(margins)
    return Model(lexicon, trees, calibration, base)


def _margin() -> Column:
    return vector_to_array("rawPrediction")[1]


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text, modulo 4, is 2. False without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row of ``docs(doc_id, text)``, from the text alone."""
    rows = docs.select("doc_id", "text")
    if model.trees is None:
        return rows.select("doc_id", F.lit(float(model.base)).alias("score"))
    lexicon = model.lexicon

    @row_udf(T.ArrayType(T.DoubleType()), BLOCK_BYTES)
    def described(column: pa.Array) -> pa.Array:
        out = features(column, lexicon)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * FEATURES, out.reshape(-1))

    judged = model.trees.transform(rows.select("doc_id", array_to_vector(described("text")).alias("features")))
    margins = judged.select("doc_id", _margin().alias("features"))
    score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return model.calibration.transform(margins).select("doc_id", score.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text, ...)``.

    Learned from ``labels(doc_id, toxic, ...)`` of documents that are not held
    out. Labels that are neither 0 nor 1 are ignored; of several labels of an id,
    1 counts. A null text counts as empty, and both are scored like others; repeated rows get
    equal scores; texts of any length are read whole, their nearness and densest passage
    inside blocks of about ``BLOCK_BYTES``. With labels of one kind only, or none,
    every score is the share of label 1. Other columns are ignored; an empty table
    gives an empty result.
    """
    model = fit(docs, labels.where(~held_out()).select("doc_id", "toxic"))
    found = scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
