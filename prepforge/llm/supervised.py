"""What the trained classifiers share: all labelled training rows, and logistic fits over Spark partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT  # noqa: F401  (the vector type must be known before rows are read)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A fit takes this many partitions at least, and rows for each of them beyond that.
FIT_PARTITIONS, FIT_ROWS = 8, 8_000


def labelled(labels: DataFrame, column: str, fold: int, held: int, key: str = "doc_id") -> DataFrame:
    """All training ids with their label (0 or 1).

    Rows of the held-out fold (crc32 of the id modulo fold equal to held), without id, or with another label are left out; of several
    labels for one id the smallest counts.
    """
    own = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{column}`").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    return shared.durable(own.filter(shared.crc_mod("id", fold) != held).groupBy("id").agg(F.min("y").alias("y")))


def is_small(known: DataFrame) -> bool:
    """Whether labels may be broadcast, by their measured number."""
    return fits(known.count())


def fits(n: int) -> bool:
    """Whether so many labels may be broadcast."""
    return n * 24 <= shared.BROADCAST_BYTES


def fit_logistic(rows: DataFrame, n_rows: int, intercept: bool, reg: float, iterations: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows of (label, features), by L-BFGS over Spark partitions, whose number follows that of the rows."""
    dealt = rows.coalesce(max(FIT_PARTITIONS, n_rows // FIT_ROWS))
    model = LogisticRegression(fitIntercept=intercept, regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-7, family="binomial").fit(dealt)
    return np.array(model.coefficients.toArray()), float(model.intercept)


def fit_differences(pairs: DataFrame, width: int, reg: float, tol: float = 1e-10, most: int = 50) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-d w)) + reg w^2 / 2 over pairs (d: array of width numbers), by Newton's method.

    Each step is one pass, by as many tasks as pairs has partitions: these hand on sums of width * width numbers, whatever their rows. It goes on until a step is below tol, so that the
    order of the sums does not show.
    """

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + width + width * width)
            for batch in batches:
                d = batch.column(0).flatten().to_numpy().reshape(-1, width)
                z = d @ w
                p = sigmoid(-z)
                total += np.r_[len(d), np.logaddexp(0, -z).sum(), -(p @ d), ((d.T * (p * (1 - p))) @ d).ravel()]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": pa.array(total)})

        found = pairs.select("d").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).coalesce(1).collect()  # a number for each place
        s = np.array([r.s for r in sorted(found)])
        n = s[0]
        return s[1] / n + reg * (w @ w) / 2, s[2 : 2 + width] / n + reg * w, s[2 + width :].reshape(width, width) / n + reg * np.eye(width)

    w = np.zeros(width)
    loss, slope, curve = sums(w)
    for _ in range(most):
        step = np.linalg.solve(curve, slope)
        if np.abs(step).max() <= tol:
            break
        while True:
            new = sums(w - step)
            if new[0] <= loss * (1 + 1e-12) or np.abs(step).max() <= tol:
                break
            step = step / 2
        w, (loss, slope, curve) = w - step, new
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
