"""Operator 7: quality rules with robust multivariate outliers.

Fixed rules come first. Then each document's vector of transformed statistics is
held against the minimum-covariance-determinant estimate of its language and source,
found as FAST-MCD does: several starts a group; two concentration steps each, which
keep the nearest ``HELD`` of the group's rows and take their mean and covariance
again; the start of least determinant goes on until its determinant falls no more.
The starts are deterministic, from medians and median deviations: independent
statistics, and correlations of their hyperbolic tangents and of spatial signs.
Every determinant is that of the covariance with ``FLOOR`` (a regularised one).

Estimates are grouped aggregates over all rows. A language and source of fewer than
``LEAST`` rows uses its language's estimate, or that of all rows; those are made
only where some source needs them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import guarded, saved, table
from .statistics import with_counts

HELD, LEAST = 0.75, 100
#: Steps of each start, steps of the best one at most, and the fall of a log-determinant that ends them.
FIRST_STEPS, STEPS, TOLERANCE = 2, 20, 1e-4
#: Spread that each statistic has at least, added to every estimate: a group of copies has none of its own.
FLOOR = (0.05, 0.3, 0.35, 0.3, 0.7, 0.5)
P = len(FLOOR)
#: A regular document's chance to be an outlier, were the statistics normal.
TAIL = 4e-6
ESTIMATE = "key string, start int, n long, m array<double>, w array<double>, logdet double, fall double"
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def chi_square(x: float, degrees: int) -> float:
    """The chance that a chi-square variable of an even number of degrees is at most x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_square_at(p: float, degrees: int) -> float:
    """The x for which ``chi_square`` is p."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if chi_square(x, degrees) < p else (low, x)
    return low


#: What makes the covariance of the nearest HELD of normal rows that of all of them, and the squared distance of outliers.
CONSISTENCY = HELD / chi_square(chi_square_at(HELD, P), P + 2)
CUTOFF = chi_square_at(1 - TAIL, P)


def vector() -> list[Column]:
    """Word length and shares of symbols, capitals, marks, repeated words and repeated lines, damped for short texts."""
    c = F.col
    share = lambda k, of, scale: F.log1p(c(k) * scale / of)
    chars, words = c("word_chars") + 200, c("n_words") + 30
    return [
        F.log((c("word_chars") + 180) / words), share("n_symbols", chars, 100), share("n_upper", chars, 100), share("n_marks", chars, 100),
        share("n_repeat_words", words, 100), share("n_dup_lines", c("n_lines") + 3, 10),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _keys() -> list[Column]:
    """A row's source with language, and its language; nulls are a group of their own."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("-")) for k in ("lang", "source"))
    return [F.concat(F.lit("2"), F.length(lang).cast("string"), lang, source), F.concat(F.lit("1"), lang)]


def _distance() -> Column:
    """Squared distance of x from m under the lower factor w (row by row)."""
    z = [F.col(f"x{i}") - F.col("m")[i] for i in range(P)]
    rows = [sum((F.col("w")[i * (i + 1) // 2 + j] * z[j] for j in range(1, i + 1)), F.col("w")[i * (i + 1) // 2] * z[0]) for i in range(P)]
    return sum((r * r for r in rows[1:]), rows[0] * rows[0])


def _square(lower: list[float]) -> np.ndarray:
    c = np.zeros((P, P))
    c[np.tril_indices(P)] = lower
    return np.tril(c) + np.tril(c, -1).T


def _estimate(mean: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse Cholesky factor and log-determinant of a covariance with FLOOR."""
    values, vectors = np.linalg.eigh(c)
    low = np.linalg.cholesky((vectors * np.maximum(values, 0)) @ vectors.T + np.diag(np.square(FLOOR)))
    return mean, np.linalg.inv(low)[np.tril_indices(P)], float(2 * np.log(np.diag(low)).sum())


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    columns = list(zip(*found)) if found else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), kind, kind, pa.float64(), pa.float64()))], [c.split()[0] for c in ESTIMATE.split(", ")])


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimates from the mean and second moments of the nearest rows, and how far their determinants fell."""
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in ("key", "start", "n", "logdet", "mean", "second")))
        found = [(key, start, n, before, *_estimate(np.array(m), CONSISTENCY * (_square(s) - np.outer(m, m)))) for key, start, n, before, m, s in rows]
        yield _rows_of([(key, start, n, m, w, logdet, before - logdet) for key, start, n, before, m, w, logdet in found])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three estimates a group, from medians, deviations and moments of tangents and of signs."""
    for batch in batches:
        found = []
        for key, n, middle, spread, tangents, signs in zip(*(batch.column(k).to_pylist() for k in ("key", "n", "middle", "spread", "tangents", "signs"))):
            for start, moments in enumerate((None, tangents, signs)):
                c = np.eye(P) if moments is None else _square(moments)
                scale = np.sqrt(np.maximum(np.diag(c), 1e-9))
                found.append((key, start, n, *_estimate(np.array(middle), c / np.outer(scale, scale) * np.outer(spread, spread)), 0.0))
        yield _rows_of(found)


def _nearer(rows: DataFrame, now: DataFrame) -> tuple[DataFrame, float]:
    """A concentration step of every start, and by how much a log-determinant fell at most."""
    far = rows.join(now, "key").withColumn("d", _distance())
    cut = far.groupBy("key", "start").agg(F.percentile_approx("d", HELD).alias("cut"))
    near = far.join(cut, ["key", "start"]).where("d <= cut")
    moments = near.groupBy("key", "start", "n", "logdet").agg(F.array(*(F.avg(f"x{i}") for i in range(P))).alias("mean"), F.array(*(F.avg(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in LOWER)).alias("second"))
    seen = Observation()
    after = saved(moments.mapInArrow(_factors, ESTIMATE).observe(seen, F.max("fall").alias("fall")))
    fall = seen.get["fall"]
    return after, 0.0 if fall is None else fall


def least_determinant(rows: DataFrame) -> DataFrame:
    """The estimate of each ``key`` of ``rows`` (key and x0, x1, ...)."""
    middle = saved(rows.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.percentile_approx(f"x{i}", 0.5) for i in range(P))).alias("middle")))
    off = [F.col(f"x{i}") - F.col("middle")[i] for i in range(P)]
    spread = saved(rows.join(middle, "key").groupBy("key", "n", "middle").agg(F.array(*(F.percentile_approx(F.abs(off[i]), 0.5) * 1.4826 + FLOOR[i] for i in range(P))).alias("spread")))
    z = rows.join(spread, "key").select("key", "n", "middle", "spread", *((off[i] / F.col("spread")[i]).alias(f"z{i}") for i in range(P)))
    z = z.withColumn("size", sum((F.pow(f"z{i}", 2.0) for i in range(1, P)), F.pow("z0", 2.0)))
    both = {"tangents": lambda i, j: F.tanh(f"z{i}") * F.tanh(f"z{j}"), "signs": lambda i, j: F.when(F.col("size") > 0, F.col(f"z{i}") * F.col(f"z{j}") / F.col("size")).otherwise(0.0)}
    starts = z.groupBy("key", "n", "middle", "spread").agg(*(F.array(*(F.avg(of(i, j)) for i, j in LOWER)).alias(name) for name, of in both.items()))
    now = saved(starts.mapInArrow(_starts, ESTIMATE))
    for _ in range(FIRST_STEPS):
        now, _ = _nearer(rows, now)
    best = saved(now.groupBy("key").agg(F.min(F.struct("logdet", "start", "n", "m", "w")).alias("best")).select("key", "best.start", "best.n", "best.m", "best.w", "best.logdet"))
    for _ in range(STEPS):
        after, fall = _nearer(rows, best)
        if fall <= TOLERANCE:
            break
        best = after
    return best


def estimates(stats: DataFrame) -> DataFrame:
    """(leaf, m, w): for each language and source of ``stats`` (lang, source and COUNTS) the estimate that its rows are held against."""
    leaf, language = _keys()
    rows = saved(stats.where(~base_failed()).select(leaf.alias("leaf"), language.alias("language"), *(v.alias(f"x{i}") for i, v in enumerate(vector()))))
    leaves = saved(rows.groupBy("leaf", "language").agg(F.count("*").alias("n")))
    languages = leaves.groupBy("language").agg(F.sum("n").alias("n_language"), F.min("n").alias("smallest"))
    uses = F.when(F.col("n") >= LEAST, F.col("leaf")).when(F.col("n_language") >= LEAST, F.col("language")).otherwise("0")
    leaves = saved(leaves.join(languages, "language").withColumn("key", uses))
    every = F.lit("0") if leaves.where("key = '0'").head(1) else F.lit(None)
    enters = F.array_compact(F.array(F.when(F.col("n") >= LEAST, F.col("leaf")), F.when((F.col("smallest") < LEAST) & (F.col("n_language") >= LEAST), F.col("language")), every))
    rows = saved(rows.join(leaves.select("leaf", enters.alias("keys")), "leaf").select(F.explode("keys").alias("key"), *(f"x{i}" for i in range(P))))
    return saved(leaves.select("leaf", "key").join(least_determinant(rows), "key").select("leaf", "m", "w"))


def judged(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """``stats`` with base_failed, distance and kept. ``groups`` is a row a source; Spark broadcasts it if its written size allows."""
    rows = stats.withColumns({"base_failed": base_failed(), "leaf": _keys()[0], **{f"x{i}": v for i, v in enumerate(vector())}}).join(groups, "leaf", "left")
    rows = rows.withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= CUTOFF))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The counts, base_failed, distance and kept of every row of ``docs`` (doc_id, text, lang, source; others are ignored).

    Null and empty texts have no words and fail. A missing language or source is a group of its own.
    Rows that fail the fixed rules don't enter the estimates; where all rows of a group fail, it has none. Repeated rows repeat; no rows give none.
    """
    stats = saved(with_counts(docs, ["doc_id", "lang", "source"]))
    return judged(stats, estimates(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_regular(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that fail the rules or are outliers."""
    groups = estimates(saved(with_counts(docs, ["lang", "source"])))
    return guarded(docs, lambda rows: judged(with_counts(rows, rows.columns), groups).where("kept"))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
