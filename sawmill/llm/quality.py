"""Operator 5: quality by regularised quadratic discriminant.

Twelve transformed statistics of the text alone; a mean and a shrunk covariance of
each class from sums over all labelled training rows; a score from the difference of
the two Mahalanobis log-densities, through Cholesky factors that are computed once
and kept in the model. A last one-dimensional logistic fit, on the training rows'
histogram of that difference, puts the score on a scale of 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, steps, table, texts_of
from .statistics import counts
from .words import STEP_BYTES

FEATURES, SHRINKAGE, THRESHOLD = 12, 0.05, 0.7
#: Bins of the calibrating histogram, a fixed number, and the ridge of its fit.
BINS, RIDGE = 400, 1e-5


def features(texts: list[str]) -> np.ndarray:
    """FEATURES transformed statistics of each text; an empty text has those of no words."""
    if not texts:
        return np.empty((0, FEATURES))
    c = {k: v.astype(float) for k, v in counts(texts).items()}
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    share = lambda k, of, scale: np.log1p(scale * c[k] / of)
    return np.stack([
        np.log(c["word_chars"] + 1) - np.log(n + 0.5), share("n_symbols", chars, 100), share("n_upper", chars, 30), share("n_marks", chars, 100),
        share("n_stops", chars, 30), share("n_digits", chars, 100), share("n_other", chars, 100), share("n_repeat_words", n, 20),
        share("n_dup_lines", np.maximum(c["n_lines"], 1), 10), np.log(c["n_different"] + 1) - 0.85 * np.log(n + 1), np.log((n + 1) / (c["n_lines"] + 1)), np.log(n + 1),
    ], axis=1)


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and offsets of classes 0 and 1, and the calibration; ``None`` where there was too little to fit."""

    prior: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    offsets: tuple[float, float] | None = None
    slope: float = 1.0
    intercept: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        if self.means is None:
            return np.zeros(len(x))
        zero, one = (o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets))
        return one - zero

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.intercept, -500, 500)))

    def column(self, text: Column | str = "text") -> Column:
        """The score of a text column, without a shuffle."""

        @F.pandas_udf("double")
        def score(texts):
            import pandas as pd

            texts = texts.fillna("").tolist()
            out, at, size = [], 0, 0
            for i, t in enumerate([*texts, None]):
                if t is None or size > STEP_BYTES:
                    out.append(self.score(features(texts[at:i])))
                    at, size = i, 0
                size += len(t or "")
            return pd.Series(np.concatenate(out))

        return score(text)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row of ``docs``, written out for several readers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps([whole], chars=STEP_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(features(texts_of(batch)).ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows that aren't held out; sums reach the driver, rows don't.

    Labels other than 0 and 1 and rows without doc_id are left out. With fewer than two rows
    of a class the score is the share of label 1 (0.5 without any).
    """
    train = saved(stats.join(labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long"), "quality"), "doc_id").where(~held_out()).select("quality", "x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for batch in batches:
            x, y = _x(batch), batch.column("quality").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    got = {r["at"]: r["v"] for r in train.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}  # a fixed number
    size = 1 + FEATURES + FEATURES * FEATURES
    moments = np.array([got.get(i, 0.0) for i in range(2 * size)]).reshape(2, size)
    n = moments[:, 0]
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return Model(prior)
    means = moments[:, 1 : 1 + FEATURES] / n[:, None]
    second = moments[:, 1 + FEATURES :].reshape(2, FEATURES, FEATURES) / n[:, None, None]
    within = [s - np.outer(m, m) for s, m in zip(second, means)]
    scale = np.sqrt(np.maximum(np.diag((n[0] * within[0] + n[1] * within[1]) / n.sum() + prior * (1 - prior) * np.outer(means[1] - means[0], means[1] - means[0])), 1e-6))
    pooled = (n[0] * within[0] + n[1] * within[1]) / n.sum() / np.outer(scale, scale)
    factors, offsets = [], []
    for k in (0, 1):
        c = within[k] / np.outer(scale, scale)
        c = (1 - SHRINKAGE) * c + SHRINKAGE * (pooled / 2 + np.eye(FEATURES) * max(np.trace(c) / FEATURES, 1e-3) / 2)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low) / scale)
        offsets.append(float(np.log(n[k]) - np.log(np.diag(low)).sum()))
    model = Model(prior, (means[0], means[1]), (factors[0], factors[1]), (offsets[0], offsets[1]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.floor(np.clip(np.arcsinh(model.difference(_x(batch))) * 10, -BINS // 2, BINS // 2)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(t)], ["quality", "bin"])

    rows = train.mapInArrow(binned, "quality int, bin int").groupBy("quality", "bin").count().collect()  # 2 * BINS rows at most
    t = np.array([(r["bin"] + 0.5) / 10 for r in rows])
    y = np.array([r["quality"] for r in rows], float)
    w = np.array([r["count"] for r in rows], float)
    w = w / w.sum()
    slope, intercept = 1.0, 0.0
    for _ in range(200):  # Newton
        p = 1 / (1 + np.exp(-np.clip(slope * t + intercept, -30, 30)))
        g = np.array([(w * (p - y) * t).sum() + RIDGE * slope, (w * (p - y)).sum()])
        q = w * p * (1 - p)
        h = np.array([[(q * t * t).sum() + RIDGE, (q * t).sum()], [(q * t).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        slope, intercept = slope - step[0], intercept - step[1]
    return Model(model.prior, model.means, model.factors, model.offsets, float(max(slope, 1e-6)), float(intercept))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null and empty texts are scored as texts of no words;
    rows without doc_id are not held out; repeated rows repeat; no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_x(batch)))], ["doc_id", "score"])

    rows = stats.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score under THRESHOLD; all of them where nothing could be fitted."""
    model = fit(described(docs), labels)
    return docs if model.means is None else docs.where(model.column() >= THRESHOLD)


def op5_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = described(table(spark, sf_dir, "documents"))
    return scored(stats, fit(stats, table(spark, sf_dir, "labels")))
