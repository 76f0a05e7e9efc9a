"""Blends, weight searches, strategy tables and pseudo-label selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import smape
from .ranks import percent_rank_average

#: Cells (rows times weight combinations) that a task of a weight search holds at once: few enough for a processor's cache.
CELLS = 1 << 17
#: Weight combinations beyond which it pays to meet equal rows first.
MANY = 256


def blend_log(weights: Mapping[str, float]) -> Column:
    """Weighted sum of log predictions, as a price."""
    return F.expm1(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)))


def blend_price(weights: Mapping[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def blend_scale_fixed(weights: Mapping[str, float]) -> Column:
    """Prices mixed on the log1p scale."""
    return F.expm1(sum((F.log1p(F.greatest(F.col(c), F.lit(1e-9))) * w for c, w in weights.items()), F.lit(0.0)))


def average(*columns: str) -> Column:
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


def rank_average(df: DataFrame, columns: Sequence[str], out: str, number: str | None = None) -> DataFrame:
    """The mean of the columns' percent ranks. number: a column of how many equal rows a row stands for."""
    names = [f"__rank_{i}" for i in range(len(columns))]
    for c, n in zip(columns, names, strict=True):
        df = percent_rank_average(df, c, n, number)
    return df.withColumn(out, average(*names)).drop(*names)


def meta_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raw predictions with their percent ranks: take the raw, the rank, or both sets of columns."""
    for c in columns:
        df = percent_rank_average(df, c, f"{c}_rank")
    return df


def weight_grid(low: float = 0.3, high: float = 0.5, step: float = 0.05, third: tuple[float, float] = (0.2, 0.5)) -> list[tuple[float, float, float]]:
    n = round((high - low) / step) + 1
    side = [round(low + i * step, 10) for i in range(n)]
    return [(a, b, round(1 - a - b, 10)) for a in side for b in side if third[0] - 1e-9 <= 1 - a - b <= third[1] + 1e-9]


def simplex_grid(steps: int = 100) -> list[tuple[float, float, float]]:
    return [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]


def search_weights(df: DataFrame, columns: Sequence[str], y: str, grid: Sequence[tuple[float, ...]], log: bool = True) -> DataFrame:
    """smape of every weight combination in one pass: a task multiplies its rows, block by block, with the matrix of weights and hands on one sum for each combination.

    Rows with a null count for nothing; without other rows smape is null. Where combinations are many, equal rows are worked on once, with their number.
    """
    weights = np.array(grid, dtype=float)
    block, across = max(1, CELLS // len(weights)), np.ascontiguousarray(weights.T)

    def sums(batches):
        total, n = np.zeros(len(weights)), 0
        held = np.empty((2, block, len(weights)))
        for b in batches:
            number, true, *predicted = (c.to_numpy() for c in b.columns)
            predicted = np.column_stack(predicted)
            for lo in range(0, len(true), block):
                at = true[lo : lo + block, None]
                mix, off = held[:, : len(at)]
                np.matmul(predicted[lo : lo + block], across, out=mix)
                if log:
                    np.expm1(mix, out=mix)
                np.abs(np.subtract(at, mix, out=off), out=off)
                size = np.add(np.abs(mix, out=mix), np.abs(at), out=mix)
                if not size.all():
                    size[size == 0] = 1  # both are zero, and so is what is off
                off /= size
                total += 2 * (number[lo : lo + block].astype(float) @ off)
            n += int(number.sum())
        yield pa.record_batch([np.arange(len(weights)), total, np.full(len(weights), n)], names=["i", "s", "n"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([y, *columns])])
    rows = rows.filter(" and ".join(f"{c} is not null" for c in rows.columns))
    names = rows.columns
    rows = rows.groupBy(*names).agg(F.count("*").alias("n")).select("n", *names) if len(weights) > MANY else rows.select(F.lit(1).cast("long").alias("n"), *names)
    scores = rows.mapInArrow(sums, "i long, s double, n long").groupBy("i").agg((F.try_divide(F.sum("s"), F.sum("n")) * 100).alias("smape"))
    names = [f"w_{c}" for c in columns]
    schema = ", ".join(["i long", *[f"`{c}` double" for c in names]])
    table = df.sparkSession.createDataFrame([(i, *map(float, w)) for i, w in enumerate(grid)], schema)
    return table.join(scores, "i", "left").select(*[F.col(f"`{c}`") for c in names], "smape")


def best(table: DataFrame, score: str, largest: bool = False) -> DataFrame:
    order = F.desc(score) if largest else F.asc(score)
    return table.orderBy(order, *[c for c in table.columns if c != score]).limit(1)


def decide(strategies: DataFrame, simple: str, gain: float = 0.003) -> DataFrame:
    """The best of (strategy, score) by score, but the simple one unless the gain reaches the limit."""
    top = strategies.agg(F.max_by("strategy", F.struct("score", "strategy")).alias("best"), F.max("score").alias("best_score"), F.max(F.when(F.col("strategy") == simple, F.col("score"))).alias("simple_score"))
    return top.withColumn("chosen", F.when(F.col("best_score") - F.col("simple_score") >= gain, F.col("best")).otherwise(F.lit(simple)))


def confident(predictions: DataFrame, key: str, p: str, limit: float = 0.05) -> DataFrame:
    """key and mean prediction of the rows on which models (one row each) agree: population deviation below limit."""
    return predictions.groupBy(key).agg(F.avg(p).alias(p), F.stddev_pop(p).alias("spread")).filter(F.col("spread") < limit)


def model_table(df: DataFrame, y: str, models: Sequence[str]) -> DataFrame:
    """mae and smape of each model's price column, in one pass."""
    row = df.agg(*[F.struct(F.round(F.avg(F.abs(F.col(y) - F.col(m))), 6).alias("mae"), F.round(smape(y, m), 6).alias("smape")).alias(m) for m in models])
    return row.unpivot([], list(models), "model", "s").select("model", "s.mae", "s.smape")
