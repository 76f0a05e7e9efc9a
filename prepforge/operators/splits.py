"""Splits and folds from hashes of the key: the same whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .joins import small
from .ranks import _running, quantile_bins, ranges


def _hash(key: str, seed: int):
    return F.xxhash64(F.col(key), F.lit(seed))


def stratum_places(df: DataFrame, key: str, by: str, seed: int) -> DataFrame:
    """df with the row's place (from 0) in its stratum by hash of the key, and the stratum's rows. Hashes are even, so ranges of them are known beforehand: rows are dealt out once, no stratum meets in one task, and its parts in the ranges give the offsets."""
    n = ranges(df)
    at = F.least(F.floor((F.col("__h").cast("double") / 2.0**64 + 0.5) * n), F.lit(n - 1)).cast("int")
    ranged = df.withColumn("__h", _hash(key, seed)).withColumn("__part", at).repartitionById(n, "__part").sortWithinPartitions(by, "__h", key)
    ranged = durable(ranged.withColumn("__i", F.monotonically_increasing_id()).drop("__h"))  # grows with the rows of a partition
    parts = ranged.groupBy(F.col(by).alias("__s"), F.col("__part").alias("__p")).agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy("__s")  # a row for each range
    before = F.coalesce(F.sum("__n").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = durable(parts.select("__s", "__p", (F.col("__first") - before).alias("__first"), F.sum("__n").over(own).alias("__size")))
    joined = ranged.join(small(parts), (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__s")))
    return joined.select(*df.columns, (F.col("__i") - F.col("__first")).alias("__place"), "__size")


def holdout(df: DataFrame, key: str, by: str, share: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """train or val within each stratum: the first share of its rows by hash is val. Keys are unique, rows without one are left out."""
    placed = stratum_places(df.filter(F.col(key).isNotNull()), key, by, seed)
    return placed.withColumn(out, F.when(F.col("__place") < F.round(F.col("__size") * share), "val").otherwise("train")).drop("__place", "__size")


def holdout_by_target(df: DataFrame, key: str, target: str, share: float = 0.2, bins: int = 10, seed: int = 42) -> DataFrame:
    """Stratified by quantile bins of log1p(target)."""
    binned = quantile_bins(df.withColumn("__log", F.log1p(F.greatest(F.col(target).cast("double"), F.lit(0.0)))), "__log", bins, "__bin")
    return holdout(binned, key, "__bin", share, seed).drop("__log", "__bin")


def k_fold(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(_hash(key, seed), F.lit(k)).cast("int"))


def stratified_k_fold(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Folds whose class counts differ by one at most. Keys are unique, rows without one are left out."""
    placed = stratum_places(df.filter(F.col(key).isNotNull()), key, label, seed)
    return placed.withColumn("fold", F.pmod("__place", F.lit(k)).cast("int")).drop("__place", "__size")


def group_k_fold(df: DataFrame, group: str, k: int) -> DataFrame:
    """One fold for each group; groups by falling size are dealt to and fro over the folds. Groups are ranked in ranges; rows without a group are left out."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg((-F.count("*")).alias("size"))
    ranked = _running(sizes.select(F.struct("size", "g").alias("__v"), F.lit(1).alias("__n")), "__v", "__n")
    turn, place = F.floor(F.col("before") / k), F.pmod("before", F.lit(k))
    fold = F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int")
    return df.join(ranked.select(F.col("__v.g").alias(group), fold.alias("fold")), group)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy("fold", group).agg(F.count("*").alias("n"))


def fold_mean(predictions: DataFrame, key: str, p: str) -> DataFrame:
    """Mean of the folds' predictions for each row."""
    return predictions.groupBy(key).agg(F.avg(p).alias(p))
