"""Encoders that are fitted on training rows: scaling, frequencies, one-hot, leakage guard, label noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import exists
from .columns import missing_flag, product, ratio
from .joins import look_up
from .ranks import percent_rank_average


class Scaler:
    """Standard scaling with the population deviation; nulls are left out of the fit and stay null; a deviation below floor becomes 1 (or floor)."""

    def __init__(self, train: DataFrame, columns: Sequence[str], floor: float | None = None):
        row = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.stats = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}
        self.floor = floor

    def transform(self, df: DataFrame) -> DataFrame:
        def one(c: str) -> Column:
            m, s = self.stats[c]
            return (F.col(c).cast("double") - m) / (max(s, self.floor) if self.floor is not None else (s or 1.0))

        return df.withColumns({c: one(c) for c in self.stats})

    def save(self, spark: SparkSession, path: str) -> None:
        """One row for each column."""
        rows = [(c, float(m), float(s), self.floor) for c, (m, s) in self.stats.items()]
        spark.createDataFrame(rows, "name string, mean double, std double, floor double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).collect()  # one row a column
        made = cls.__new__(cls)
        made.stats, made.floor = {r.name: (r["mean"], r["std"]) for r in rows}, rows[0].floor if rows else None
        return made

    @classmethod
    def stored(cls, paths: Sequence[str], train: DataFrame, columns: Sequence[str], floor: float | None = None) -> Scaler:
        """The scaler under the first path that exists and knows all columns; without one it is fitted on train and kept under the last path."""
        spark = train.sparkSession
        for path in paths:
            if exists(spark, path) and set(columns) <= (made := cls.load(spark, path)).stats.keys():
                return made
        made = cls(train, columns, floor)
        made.save(spark, paths[-1])
        return made


class FrequencyEncoder:
    """Counts of values on training rows; missing is a value of its own, unseen values count 1. number: a column of how many equal rows a row stands for."""

    def __init__(self, train: DataFrame, c: str, number: str | None = None):
        self.c = c
        self.counts = train.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("level")).agg((F.sum(number) if number else F.count("*")).alias("freq"))

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        keyed = df.withColumn("__level", F.coalesce(F.col(self.c).cast("string"), F.lit("MISSING")))
        return look_up(keyed, "__level", self.counts, "level", "freq", 1, out).drop("__level")


def one_hot(train: DataFrame, columns: Sequence[str]):
    """Fitted indexers and encoders; a missing value is a level, an unknown one is all zeros."""
    from pyspark.ml import Pipeline

    stages = [StringIndexer(inputCol=f"{c}__level", outputCol=f"{c}__i", handleInvalid="keep") for c in columns]
    stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True, handleInvalid="keep"))
    return Pipeline(stages=stages).fit(with_levels(train, columns))


def with_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}__level": F.coalesce(F.col(c).cast("string"), F.lit("MISSING")) for c in columns})


def one_hot_capped(df: DataFrame, c: str, levels: Sequence[str], limit: int = 25) -> dict[str, Column]:
    """One 0/1 column for each level; beyond limit levels a single column for unknown."""
    x = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    if len(levels) > limit:
        return {f"{c}_unknown": F.lit(1)}
    return {f"{c}_{v}": (x == v).cast("int") for v in levels}


def leaking(df: DataFrame, target: str, columns: Sequence[str], limit: float = 0.9) -> list[str]:
    """Columns whose correlation with the target is beyond limit."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and abs(row[c]) > limit]


def label_noise(key: str, label: str, share: float = 0.05, seed: int = 42) -> Column:
    """A share of labels becomes a coin flip, decided by hashes of the key: the same on every run."""
    draw = lambda salt: F.pmod(F.xxhash64(F.col(key), F.lit(seed + salt)), F.lit(1_000_000)) / 1_000_000
    return F.when(draw(0) < share, (draw(1) < 0.5).cast("int")).otherwise(F.col(label))


class ClaimEngineer:
    """Interactions, missing flags, frequency and ranks: fitted on training rows of a fold, applied to any rows. number: a column of how many equal rows a training row stands for."""

    def __init__(self, train: DataFrame, frequency: str, products: Sequence[tuple[str, str]] = (), ratios: Sequence[tuple[str, str]] = (), flags: Sequence[str] = (), ranked: Sequence[str] = (), number: str | None = None):
        self.frequency = FrequencyEncoder(train, frequency, number)
        self.products, self.ratios, self.flags, self.ranked = products, ratios, flags, ranked

    def transform(self, df: DataFrame) -> DataFrame:
        new = {f"eng_{a}_x_{b}": product(a, b) for a, b in self.products} | {f"eng_{a}_div_{b}": ratio(a, b) for a, b in self.ratios}
        new |= {f"eng_{c}_is_missing": missing_flag(c) for c in self.flags}
        out = self.frequency.transform(df.withColumns(new), f"{self.frequency.c}_freq").drop(self.frequency.c)
        for c in self.ranked:
            out = percent_rank_average(out, c, f"{c}_rank")
        return out
