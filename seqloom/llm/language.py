"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed n-grams of their letters, weighed by how few texts hold them. Document
frequencies are counted over all texts to learn from; the weights are learned from a bounded sample
of these by the follow-the-regularized-leader update with an elastic-net penalty, which leaves most
of them at zero; a temperature fitted on a part of the sample that the weights haven't seen turns
scores into probabilities. Scoring is a column function over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.shipping import ship_package

#: Letters of an n-gram, and bits of its hash.
ORDERS, BITS = (1, 2, 3, 4), 15
DIMENSIONS = 1 << BITS
#: Texts that a fit samples at most, of each language alike, and every how many of them set the temperature.
SAMPLE_ROWS, CALIBRATION = 4000, 5
#: Passes over the sample, and step sizes and penalties of the update.
PASSES, ALPHA, BETA, L1, L2 = 5, 1.0, 1.0, 0.1, 0.1
#: Characters that are hashed together, about.
TOGETHER = 1 << 19
#: What texts without a letter are predicted as.
UNDETERMINED = "und"
#: Languages that are told apart at most, the most frequent ones; rarer values are not learned.
MOST_LANGUAGES = 1000


def letters_only(texts: pa.Array) -> pa.Array:
    """Texts in lower case with a blank for each run of what is no letter, and one at each end."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    blank, nothing = (pa.scalar(c, pa.large_string()) for c in (" ", ""))
    return pc.replace_substring_regex(pc.binary_join_element_wise(blank, low, blank, nothing), r"[^\p{L}]+", " ")


def gram_counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, counts) of each text, features ascending; a text without a letter has none."""
    clean = letters_only(texts)
    lengths = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    for stop in _cuts(lengths):
        points = np.frombuffer("".join(clean.slice(start, stop - start).to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.uint32)
        marks = _hashes(points)
        at = 0
        for n in lengths[start:stop].tolist():
            if n < 2:  # a blank alone
                yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                own = np.concatenate([m[at : at + n - k + 1] for k, m in zip(ORDERS, marks, strict=True) if n >= k])
                if len(own) > DIMENSIONS // 8:
                    table = np.bincount(own, minlength=DIMENSIONS)
                    found = np.flatnonzero(table)
                    yield found, table[found]
                else:
                    yield np.unique(own, return_counts=True)
            at += n
        start = stop


def _cuts(lengths: np.ndarray) -> list[int]:
    """Ends of runs of texts that are hashed together."""
    block = np.cumsum(lengths) // TOGETHER
    return [*(np.flatnonzero(np.diff(block)) + 1).tolist(), *([len(lengths)] if len(lengths) else [])]


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """The feature of the n-gram that starts at each character, for each order."""
    out, total = [], np.zeros(len(points), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            total = total[: len(points) - k] * np.uint32(0x01000193) + points[k:] * np.uint32(0x9E3779B1) + np.uint32(k + 1)
            if k + 1 in ORDERS:
                mixed = total ^ (total >> np.uint32(16))
                mixed = mixed * np.uint32(0x85EBCA6B)
                out.append((mixed >> np.uint32(32 - BITS)).astype(np.int64))
    return out


def weighed(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of one text, of length 1: logarithms of the counts by inverse document frequencies."""
    values = (1 + np.log(np.maximum(counts, 1))) * idf[features]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def log_softmax(scores: np.ndarray) -> np.ndarray:
    shifted = scores - scores.max(axis=-1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=-1, keepdims=True))


class Leader:
    """Weights by follow-the-regularized-leader: per coordinate, what gradients ask for against penalties.

    A weight stays zero until its summed gradients outweigh ``L1``; ``L2`` and the growing steps
    pull the others back.
    """

    def __init__(self, languages: int):
        self.pull = np.zeros((DIMENSIONS, languages))
        self.squares = np.zeros((DIMENSIONS, languages))
        self.bias_pull, self.bias_squares = np.zeros(languages), np.zeros(languages)

    @staticmethod
    def _weights(pull: np.ndarray, squares: np.ndarray, l1: float) -> np.ndarray:
        over = np.sign(pull) * np.maximum(np.abs(pull) - l1, 0)
        return -over / ((BETA + np.sqrt(squares)) / ALPHA + L2)

    @staticmethod
    def _moved(pull: np.ndarray, squares: np.ndarray, weights: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grown = squares + slope * slope
        return pull + slope - (np.sqrt(grown) - np.sqrt(squares)) / ALPHA * weights, grown

    def learn(self, features: np.ndarray, values: np.ndarray, language: int) -> None:
        pull, squares = self.pull[features], self.squares[features]
        weights, bias = self._weights(pull, squares, L1), self._weights(self.bias_pull, self.bias_squares, 0.0)
        error = np.exp(log_softmax(values @ weights + bias))
        error[language] -= 1
        self.pull[features], self.squares[features] = self._moved(pull, squares, weights, values[:, None] * error[None, :])
        self.bias_pull, self.bias_squares = self._moved(self.bias_pull, self.bias_squares, bias, error)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self._weights(self.pull, self.squares, L1), self._weights(self.bias_pull, self.bias_squares, 0.0)


def temperature(scores: np.ndarray, languages: np.ndarray) -> float:
    """What scores are divided by so that the likelihood of the languages is greatest, between 1/64 and 64."""
    if not len(scores):
        return 1.0
    every = np.arange(len(scores))
    loss = lambda t: -float(log_softmax(scores / 2.0**t)[every, languages].mean())
    low, high, ratio = -6.0, 6.0, (5**0.5 - 1) / 2
    for _ in range(40):  # golden section: the loss has one minimum
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return 2.0 ** ((low + high) / 2)


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, weights (feature by language), bias, and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each text, one column a language, and whether it has letters."""
        out, lettered = np.tile(self.bias, (len(texts), 1)), np.zeros(len(texts), dtype=bool)
        for k, (features, counts) in enumerate(gram_counts(texts)):
            if len(features):
                out[k] += weighed(features, counts, self.idf) @ self.weights[features]
                lettered[k] = True
        return out, lettered

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability; without letters ``und`` and 0."""
        scores, lettered = self.scores(texts)
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        odds = np.exp(log_softmax(scores / self.heat)) if len(texts) else scores
        best = odds.argmax(axis=1)
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], np.where(lettered, odds[np.arange(len(texts)), best], 0.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray, passes: int = PASSES) -> LanguageModel:
    """Learn from the (features, counts) of texts in their order; every CALIBRATION-th one sets the temperature instead."""
    names = sorted(set(languages))
    of = {name: k for k, name in enumerate(names)}
    known = [(f, weighed(f, c, idf), of[name]) for (f, c), name in zip(rows, languages, strict=True) if len(f)]
    kept = [k for k in range(len(known)) if k % CALIBRATION != CALIBRATION - 1 or len(known) < 2 * CALIBRATION]
    leader, deal = Leader(len(names)), np.random.RandomState(0)
    for _ in range(passes):
        for k in deal.permutation(len(kept)):
            leader.learn(*known[kept[k]])
    weights, bias = leader.weights()
    unseen = [known[k] for k in sorted(set(range(len(known))) - set(kept))]
    scores = np.array([values @ weights[features] + bias for features, values, _ in unseen]).reshape(len(unseen), len(names))
    return LanguageModel(names, idf, weights.astype(np.float32), bias, temperature(scores, np.array([x[2] for x in unseen], dtype=np.int64)))


def document_frequencies(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many texts each feature occurs, over all rows; one number for each feature reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            for features, _ in gram_counts(batch.column(0)):
                total[features] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["feature", "n"])

    ship_package(df.sparkSession)
    sums = df.select(text_col).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    out[[r["feature"] for r in sums]] = [r["n"] for r in sums]
    return out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, lang, features, counts) of sampled texts, the last two packed."""
    for batch in batches:
        found = list(gram_counts(batch.column(2)))
        packed = [pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["mark", "lang", "features", "counts"])


def labelled_sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 0) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """(features, counts) and languages of about ``rows`` whole texts, those of the least seeded hash of each language.

    Every language gets as many; the hash is cut where that many are expected, so what is shuffled
    and what reaches the driver (features, no texts; 8 bytes for each of a text's) is bounded whatever
    the number of rows. Texts alike are sampled once.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return [], []
    each, whole = max(1, rows // len(counts)), 1 << 30
    shares = F.map_from_arrays(F.array(*[F.lit(r["lang"]) for r in counts]), F.array(*[F.lit(min(whole, max(1, whole * each // r["n"]))) for r in counts]))
    mark = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(whole))
    picked = labelled.withColumn("mark", mark).filter(F.col("mark") < F.try_element_at(shares, "lang")).groupBy("mark", "lang", F.md5("text").alias("digest")).agg(F.min("text").alias("text"))
    found = sorted(picked.select("mark", "lang", "text").mapInArrow(_sample_features, "mark long, lang string, features binary, counts binary").collect())[: 2 * rows]
    return [tuple(np.frombuffer(r[c], dtype="<i4").astype(np.int64) for c in ("features", "counts")) for r in found], [r["lang"] for r in found]


def fit_on(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on rows (text, lang): document frequencies over all of them, weights on a bounded sample.

    Rows with a null text or language teach nothing, nor do texts without a letter. Without any, every
    text is undetermined.
    """
    usable = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    held = document_frequencies(usable)
    return fit(*labelled_sample(usable, rows), np.log((1 + usable.count()) / (1 + held)) + 1)


def predictor(model: LanguageModel, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function: text to struct<lang, score>.

    ``score`` is the calibrated probability of the language predicted. Null texts and those without a
    letter are ``und`` with a score of 0. Whole texts are read, however long; equal texts get equal
    predictions, ties go to the language first by name.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.idf.astype(np.float32), model.weights, model.bias, model.heat))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LanguageModel(*shared.value)
        for texts in batches:
            parts = [own.predict(pa.array(texts[i : i + 512], pa.string())) for i in range(0, len(texts), 512)]
            yield pd.DataFrame({"lang": [name for names, _ in parts for name in names], "score": np.round(np.concatenate([s for _, s in parts]) if parts else np.zeros(0), 9)})

    return predict


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out`` (lang, score) to each row; all other columns stay, an empty table stays empty."""
    return df.withColumn(out, predictor(model, df.sparkSession)(F.col(text_col)))
