"""Operator 5. Quality classifier: a regularised quadratic discriminant over transformed document statistics.

``fit`` takes a bounded sample of labelled documents. Each class gets a mean and a covariance; the covariance is shrunk
towards the pooled one, and that mixture towards its mean variance, as in regularised discriminant analysis. The inverse
Cholesky factor and the log-determinant of each class are computed once and travel with the model. A document's
discriminant is half the difference of the classes' squared Mahalanobis distances and log-determinants; a logistic curve
with two coefficients, fitted on the same sample, maps it to a score between 0 and 1 (monotone in the discriminant).

Scores are computed next to the scan: one pass, no exchange.

Defined cases. A null or empty text has the statistics of no words and gets a score like any other. Null labels and
labels of no document are not used. If the sample lacks a class, every score is the share of label 1 in it, smoothed
(1/2 without any label). Repeated rows get repeated scores; very long texts are read whole. A constant statistic adds nothing. Labels, language, source
and id are never inputs of a score. Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import bounded_sample, map_texts
from tidelog.llm.text_stats import SCHEMA, text_statistics

#: Labels that the model is fitted on, at most, those of the least hashes of doc_id. As a doc_id may have several rows, twice
#: as many documents may come of them, no more.
SAMPLE_ROWS = 20_000

#: Weight of the pooled covariance in each class's, and of the mean variance in that mixture.
TO_POOLED, TO_MEAN = 0.15, 0.05

#: A score from here on predicts label 1.
THRESHOLD = 0.7


def transform(s: dict[str, np.ndarray]) -> np.ndarray:
    """Document statistics to inputs of the model, one row a document: logs and roots, to be nearer to normal."""
    words, chars, lines = (np.maximum(s[n], 1).astype(float) for n in ("n_words", "word_chars", "n_lines"))
    letters = np.maximum(s["n_upper"] + s["n_lower"], 1)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            np.log(chars / words),
            np.sqrt(s["n_symbols"] / chars),
            np.sqrt(s["n_dup_lines"] / lines),
            np.sqrt(s["n_repeat_words"] / words),
            np.log(np.maximum(s["n_distinct_words"], 1) / words),
            np.sqrt(s["n_upper"] / letters),
            np.sqrt(s["n_digits"] / chars),
            np.sqrt(s["n_bangs"] / words),
            np.sqrt(s["n_stops"] / words),
            np.log(words / lines),
            np.sqrt(s["n_wide"] / chars),
        ]
    )


@dataclass
class QuadraticDiscriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None  # None: the sample lacked a class
    inverse_factors: tuple[np.ndarray, np.ndarray] | None  # of the Cholesky factors
    log_dets: tuple[float, float]
    slope: float
    offset: float

    def discriminant(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        half = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.inverse_factors, strict=True)]
        return 0.5 * (half[0].sum(1) - half[1].sum(1) + self.log_dets[0] - self.log_dets[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.slope * _tame(self.discriminant(x)) + self.offset, -35, 35)))


def _tame(d: np.ndarray) -> np.ndarray:
    """Far outliers have huge log-density differences; a signed root keeps their order."""
    return np.sign(d) * np.sqrt(np.abs(d))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_mean: float = TO_MEAN) -> QuadraticDiscriminant:
    ones = int(y.sum())
    if ones < 2 or len(y) - ones < 2:
        return QuadraticDiscriminant(np.zeros(x.shape[1]), np.ones(x.shape[1]), None, None, (0.0, 0.0), 0.0, (ones + 1) / (len(y) + 2))
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    covs = [np.cov(p, rowvar=False, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(covs, parts, strict=True)) / len(z)
    factors, log_dets = [], []
    for c in covs:
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_mean) * c + to_mean * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * float(np.log(np.diag(low)).sum()))
    model = QuadraticDiscriminant(centre, scale, (parts[0].mean(0), parts[1].mean(0)), (factors[0], factors[1]), (log_dets[0], log_dets[1]), 1.0, 0.0)
    model.slope, model.offset = _logistic(_tame(model.discriminant(x)), y)
    return model


def _logistic(d: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by Newton's method with a small ridge."""
    w = np.array([1.0, 0.0])
    a = np.column_stack([d, np.ones_like(d)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (p - y) + ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), gradient)
        size = np.abs(step).max()
        w = w - step / max(1.0, size)
        if size < 1e-9:
            break
    return max(float(w[0]), 1e-6), float(w[1])


def id_remainder(key: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``: which rows are held out."""
    return F.crc32(key.cast("string").cast("binary")) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, usable: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, label, text) of at most ``sample_rows`` usable labels; the join is a broadcast of those few numbers."""
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(bounded_sample(marks, sample_rows)), "doc_id")


def fit_documents(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, label: str = "quality") -> QuadraticDiscriminant:
    """The model of the usable labels (``usable`` is about the column doc_id)."""
    sample = labelled_sample(docs, labels, label, sample_rows, usable)
    stats = map_texts(sample, "text", ["doc_id", "label"], SCHEMA, text_statistics)
    frame = stats.orderBy(F.xxhash64("doc_id"), *stats.columns).limit(2 * sample_rows).toPandas()  # a doc_id may have several rows
    return fit(transform({c: frame[c].to_numpy() for c in stats.columns}), (frame["label"].to_numpy() > 0).astype(int))


def score_documents(docs: DataFrame, model: QuadraticDiscriminant, keep: list, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, score and predicted."""
    scored = map_texts(docs, text, keep, "score double", lambda texts: {"score": model.score(transform(text_statistics(texts)))})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
