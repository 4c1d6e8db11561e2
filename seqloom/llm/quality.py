"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Every grade shares one weight for each hashed feature of a text; ordered thresholds split that one
scale into grades: P(grade > k) = sigmoid(score - threshold_k). The expected grade and the tail
probability of the grades wanted come out of the same scale. Features enter the regression scaled by
the evidence that they tell grades apart, so that a few ratings already single out the words that
matter and long texts don't gather noise; there is no least number of rows. The model is fitted on a
bounded, seeded sample of rated texts and is a vector of fixed length; scoring is a column function.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.workers import give_back, tidy
from seqloom.plans.shipping import ship_package

#: Length of the weight vector (18 bits of hash), and rated rows that a fit samples at most.
DIMENSIONS, SAMPLE_ROWS = 1 << 18, 8000
#: The first ten of the last features stand for repetition; hashes stay below them.
REPETITION = DIMENSIONS - 10
#: Letters of the stems of a word.
STEMS = (5, 6, 7)
#: Rounds and step of the fit, and weight of the ridge in rows.
ROUNDS, STEP, RIDGE = 300, 0.05, 0.5
#: Evidence that counts as none, as a squared number of standard deviations.
NO_EVIDENCE = 9.0
#: Distinct words that a Python worker remembers.
CACHE = 50_000
#: Grades are wanted from this one up, with at least this tail probability: what is more probably
#: good than not.
WANTED, LEAST_TAIL = 2, 0.5

_SHAPES = bytes.maketrans(
    b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"a" * 26 + b"A" * 26 + b"0" * 10
)


def _features_of(word: str) -> tuple[int, ...]:
    """The hashed features of a word: its letters in lower case, its shape, and its stems (-1: none).

    A stem of a word is its first letters, so that a language's rare forms of one word are known
    by what they share; a word no longer than a stem has none of that length.
    """
    raw = word.encode()
    shape = bytearray()
    for c in raw.translate(_SHAPES):
        c = c if c < 128 else 97
        if not shape or shape[-1] != c:
            shape.append(c)
    letters = "".join(c for c in word if c.isalnum()).lower()
    stems = (zlib.crc32(b"p" + letters[:k].encode()) % REPETITION if len(letters) > k else -1 for k in STEMS)
    return zlib.crc32(b"w" + letters.encode()) % REPETITION, zlib.crc32(b"s" + bytes(shape)) % REPETITION, *stems


def features(texts: pa.Array, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a batch: which hashed features each text has.

    Words are what white space parts. A word and a stem count 1 where they occur, a shape as its share
    of the text's words times 4; one more feature tells how much the text repeats its words, in tenths.
    ``known`` remembers words within a worker.
    """
    blank = pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"[\t\n\v\f\r]", " ")
    parts = pc.split_pattern(blank, " ")
    coded = parts.flatten().dictionary_encode()
    if len(known) > CACHE:
        known.clear()
    found = []
    for word in coded.dictionary.to_pylist():
        marks = known.get(word)
        if marks is None:
            marks = known[word] = _features_of(word)
        found.append(marks)
    table = np.array(found, dtype=np.int64).reshape(-1, 2 + len(STEMS))
    counts = np.diff(parts.offsets.to_numpy())
    width = max(len(table), 1)
    pairs, times = np.unique(np.repeat(np.arange(len(counts), dtype=np.int64), counts) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, word = pairs // width, table[pairs % width]
    words = np.unique(row * DIMENSIONS + word[:, 0])
    shapes, at = np.unique(row * DIMENSIONS + word[:, 1], return_inverse=True)
    stems = np.unique((row[:, None] * DIMENSIONS + word[:, 2:])[word[:, 2:] >= 0])
    repeated = 1 - np.bincount(words // DIMENSIONS, minlength=len(counts)) / np.maximum(counts, 1)
    level = np.minimum(9, (10 * repeated).astype(np.int64))
    out = [(keys // DIMENSIONS, keys % DIMENSIONS, np.ones(len(keys))) for keys in (words, stems)]
    out.append((shapes // DIMENSIONS, shapes % DIMENSIONS, 4.0 * np.bincount(at, weights=times, minlength=len(shapes)) / counts[shapes // DIMENSIONS]))
    out.append((np.arange(len(counts)), REPETITION + level, np.ones(len(counts))))
    row, col, value = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, col, value.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    """Weights of hashed features and ascending thresholds between grades 0, 1, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array, known: dict[str, tuple[int, ...]]) -> np.ndarray:
        """P(grade > k) of each text, one column for each threshold."""
        row, col, value = features(texts, known)
        score = np.bincount(row, weights=self.weights[col] * value, minlength=len(texts))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(texts: list[str], grades: np.ndarray, rounds: int = ROUNDS) -> OrdinalModel:
    """Fit on texts and their grades 0, 1, ...; see ``fit_features``."""
    row, col, value = features(pa.array(texts, pa.string()), {}) if len(texts) else (np.zeros(0, np.int64),) * 3
    return fit_features(row, col, value, np.asarray(grades, dtype=np.int64), rounds)


def evidence(row: np.ndarray, col: np.ndarray, grades: np.ndarray, levels: int) -> np.ndarray:
    """How far each feature tells grades apart, as a number of standard deviations, less what chance gives.

    It is the root of the likelihood ratio between a feature that is as frequent above a grade as
    below it and one that isn't, the most over all grades, less NO_EVIDENCE. It grows with the rows
    that a feature is in, so that no feature needs a least number of them.
    """
    n, held = len(grades), np.bincount(col, minlength=DIMENSIONS).astype(np.float64)
    best = np.zeros(DIMENSIONS)
    part = lambda seen, due: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(due, 1e-12)), 0)
    for k in range(1, levels):
        low = grades < k
        m = int(low.sum())
        if 0 < m < n:
            below = np.bincount(col[low[row]], minlength=DIMENSIONS).astype(np.float64)
            above = held - below
            ratio = 2 * (part(below, held * m / n) + part(above, held * (n - m) / n) + part(m - below, m - held * m / n) + part(n - m - above, n - m - held * (n - m) / n))
            best = np.maximum(best, ratio)
    return np.sqrt(np.maximum(best - NO_EVIDENCE, 0))


def loss_and_slopes(weights: np.ndarray, first: float, gaps: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Mean negative log-likelihood of the grades with a ridge, and its slopes.

    Thresholds are ``first`` and what the exponentials of ``gaps`` add one after another.
    """
    n, levels = len(grades), len(gaps) + 2
    cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    score = np.bincount(row, weights=weights[at] * value, minlength=n)
    over = _sigmoid(score[:, None] - cuts[None, :])
    upper, lower = np.column_stack([np.ones(n), over]), np.column_stack([over, np.zeros(n)])
    every = np.arange(n)
    mass = np.maximum(upper[every, grades] - lower[every, grades], 1e-9)
    slope = np.column_stack([np.zeros(n), over * (1 - over), np.zeros(n)])
    d_score = -(slope[every, grades] - slope[every, grades + 1]) / mass / n
    d_cut = np.zeros(levels - 1)
    np.add.at(d_cut, np.maximum(grades - 1, 0), np.where(grades > 0, slope[every, grades] / mass, 0) / n)
    np.add.at(d_cut, np.minimum(grades, levels - 2), np.where(grades < levels - 1, -slope[every, grades + 1] / mass, 0) / n)
    d_gaps = np.array([d_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(levels - 2)])
    d_weights = np.bincount(at, weights=d_score[row] * value, minlength=len(weights)) + RIDGE / n * weights
    return float(-np.log(mass).mean() + RIDGE / n / 2 * (weights @ weights)), d_weights, float(d_cut.sum()), d_gaps


def fit_features(row: np.ndarray, col: np.ndarray, value: np.ndarray, grades: np.ndarray, rounds: int = ROUNDS) -> OrdinalModel:
    """Fit by full-batch Adam on the likelihood of the grades with a ridge, values scaled by their evidence.

    Features without evidence have no weight. Thresholds stay ordered since only the first and the
    logarithms of the gaps are free. Without rows every text gets the same score.
    """
    n, levels = len(grades), max(int(grades.max()) + 1 if len(grades) else 2, 2)
    scale = evidence(row, col, grades, levels) if n else np.zeros(DIMENSIONS)
    kept = scale[col] > 0
    row, col, value = row[kept], col[kept], value[kept] * scale[col[kept]]
    used, at = np.unique(col, return_inverse=True)
    free = [np.zeros(len(used)), np.zeros(1), np.zeros(levels - 2)]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in free]
    for step in range(1, rounds + 1 if n else 1):
        _, *slopes = loss_and_slopes(free[0], float(free[1][0]), free[2], row, at, value, grades)
        for x, (m, v), slope in zip(free, moments, slopes, strict=True):
            m[:] = 0.9 * m + 0.1 * slope
            v[:] = 0.999 * v + 0.001 * np.square(slope)
            x -= STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(DIMENSIONS, dtype=np.float32)
    full[used] = free[0] * scale[used]
    return OrdinalModel(full, free[1][0] + np.concatenate(([0.0], np.cumsum(np.exp(free[2])))))


def rated_sample(docs: DataFrame, ratings: DataFrame, grade: Column, rows: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """About ``rows`` rated documents (mark, doc_id, text, grade), those of the least seeded hash.

    The hash is cut at the share that is expected to give ``rows``, so what is joined stays
    bounded whatever the number of ratings. Rows without grade are left out, an id counts once with
    its least grade and text. Ids are compared by their text, so their types may differ on both sides.
    """
    key = F.col("doc_id").cast("string")
    mark = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000))
    graded = ratings.select(key.alias("doc_id"), grade.cast("int").alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    total = graded.count()
    share = min(1_000_000, int(1_000_000 * rows / max(total, 1)))
    picked = graded.withColumn("mark", mark).filter(F.col("mark") < share)
    texts = docs.select(key.alias("doc_id"), "text").filter(mark < share).groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(picked, "doc_id").select("mark", "doc_id", "text", "grade")


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, doc_id, grade, features, values) of sampled rows, the last two packed."""
    for batch in batches:
        row, col, value = features(batch.column(2), {})
        order = np.argsort(row, kind="stable")
        ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))[:-1]
        packed = [pa.array([x.tobytes() for x in np.split(v[order], ends)], pa.binary()) for v in (col.astype("<i4"), value.astype("<f4"))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *packed], ["mark", "doc_id", "grade", "features", "values"])


def fit_on(docs: DataFrame, ratings: DataFrame, grade: Column, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on a bounded sample of rated documents; without any, every text gets the same score.

    Needs ``doc_id`` and ``text`` in ``docs`` and ``doc_id`` in ``ratings``; further columns are ignored.
    Null ids match no rating. Of repeated rows with one id the least text and the least grade count, so ties
    don't matter; ids may be of two types. Texts are read whole, however long.
    Executors make the features; the driver gets those of ``rows`` documents at most, not texts.
    """
    ship_package(docs.sparkSession)
    sample = rated_sample(docs, ratings, grade, rows)
    packed = sample.mapInArrow(tidy(_sample_features), "mark long, doc_id string, grade int, features binary, values binary")
    found = sorted(packed.collect(), key=lambda r: (r["mark"], r["doc_id"]))[:rows]
    if not found:
        return fit([], np.zeros(0))
    col = [np.frombuffer(r["features"], dtype="<i4") for r in found]
    row = np.repeat(np.arange(len(found)), [len(c) for c in col])
    value = np.concatenate([np.frombuffer(r["values"], dtype="<f4") for r in found])
    return fit_features(row, np.concatenate(col), value, np.array([r["grade"] for r in found], dtype=np.int64))


#: Ratings of the labels table as one grade, how many of them a document passes: 0 none (low quality and
#: toxic), 1 one of them, 2 both. A rating that is missing leaves the document out.
LABEL_GRADE = "CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE (quality = 1)::int + (toxic = 0)::int END"


def scorer(model: OrdinalModel, spark, wanted: int = WANTED) -> Callable[[Column], Column]:
    """A column function: text to struct<expected_grade, tail_prob>.

    ``tail_prob`` is P(grade >= wanted). Null and empty texts are scored as texts without words.
    Whole texts are scored, however long. Equal texts get equal scores. Each row has its score,
    whatever further columns there are.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, tail_prob double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, known = OrdinalModel(*shared.value), {}
        for texts in batches:
            tails = np.vstack([own.tails(pa.array(texts[i : i + 512], pa.string()), known) for i in range(0, len(texts), 512)] or [np.zeros((0, len(own.thresholds)))])
            yield pd.DataFrame({"expected_grade": np.round(tails.sum(axis=1), 9), "tail_prob": np.round(tails[:, min(wanted, tails.shape[1]) - 1], 9)})
        known.clear()
        give_back()

    return score


def select_quality(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL, wanted: int = WANTED) -> DataFrame:
    """The documents whose tail probability is high enough, with all their columns.

    Rows are judged one by one: repeated ones stay or go together, an empty table stays empty.
    """
    score = scorer(model, docs.sparkSession, wanted)
    return docs.filter(score(F.col("text"))["tail_prob"] >= least_tail)
