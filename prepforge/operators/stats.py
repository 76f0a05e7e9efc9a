"""Aggregations: frequency tables, profiles, missing reports, percentiles, correlations, histograms, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import exact_percentiles


def slot_counts(events: DataFrame, key: str, slot: str = "slot") -> DataFrame:
    """Events by key and slot; rows without slot are left out."""
    return events.filter(F.col(slot).isNotNull()).groupBy(key, slot).agg(F.count("*").alias("n"))


def slot_matrix(events: DataFrame, key: str, slot: str = "slot", slots: int = 28) -> DataFrame:
    """slot_1_engagements ... for each key that has any event in a slot; 0 in its empty slots."""
    sums = [F.count(F.when(F.col(slot) == s, 1)).alias(f"slot_{s}_engagements") for s in range(1, slots + 1)]
    return events.filter(F.col(slot).isNotNull()).groupBy(key).agg(*sums)


def value_counts(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(c).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), F.col(c).asc_nulls_first()).limit(top)


def blank_share(df: DataFrame, *columns: str) -> DataFrame:
    """Percentage of null or blank values of each column, in one pass."""
    pct = lambda c: F.round(100 * F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").cast("int")), 6)
    row = df.agg(*[pct(c).alias(c) for c in columns])
    return row.unpivot([], list(columns), "name", "blank_pct")


def missing_report(df: DataFrame) -> DataFrame:
    """name, missing and pct of every column, in one pass."""
    n = df.agg(F.count("*").alias("__n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns])
    return n.unpivot(["__n"], df.columns, "name", "missing").select("name", "missing", F.round(100 * F.col("missing") / F.col("__n"), 6).alias("pct"))


def profile(df: DataFrame, c: str) -> DataFrame:
    """One row: non-null count, null share, distinct values, and text lengths or numeric range."""
    x = F.col(c)
    shared = [F.lit(c).alias("name"), F.count(x).alias("non_null"), F.round(100 * F.avg(x.isNull().cast("int")), 6).alias("null_pct"), F.count_distinct(x).alias("n_unique")]
    if dict(df.dtypes)[c] == "string":
        n = F.length(x)
        low, high, mean, mid = F.min(n).cast("double"), F.max(n).cast("double"), F.avg(n), F.median(n)
    else:
        x = x.cast("double")
        low, high, mean, mid = F.min(x), F.max(x), F.avg(x), F.median(x)
    return df.agg(*shared, low.alias("low"), high.alias("high"), F.round(mean, 6).alias("mean"), F.round(mid, 6).alias("median"))


def coverage(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values by split."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.round(100 * F.avg(F.col(c).isNotNull().cast("int")), 6).alias(f"{c}_pct") for c in columns])


def nulls_left(df: DataFrame) -> DataFrame:
    """One row: nulls in all columns together."""
    return df.agg(F.coalesce(F.sum(sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))), F.lit(0)).alias("nulls"))


def summary(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    """min, median, max, mean and population deviation."""
    x, keys = F.col(c).cast("double"), [by] if by else []
    plain = df.groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))
    median = exact_percentiles(df, c, {"median": 0.5}, keys).withColumn("median", F.round("median", 6))
    if not by:
        return plain.crossJoin(median).select("min", "median", "max", "mean", "std")  # one row each
    both = plain.join(median.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left")
    return both.select(by, "min", "median", "max", "mean", "std")


def fold_summary(scores: DataFrame, by: str, score: str) -> DataFrame:
    return scores.groupBy(by).agg(F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("std"))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives for each positive."""
    return df.agg((F.sum((F.col(label) == 0).cast("int")) / F.sum((F.col(label) == 1).cast("int"))).alias("neg_over_pos"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weights that sum to the number of classes."""
    n = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum(1 / F.col("n")).alias("inv"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("k") / F.col("n") / F.col("inv"), 9).alias("weight"))  # one row on the right


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 9).alias("agreement"))


def mean_importance(folds: DataFrame) -> DataFrame:
    return folds.groupBy("feature").agg(F.round(F.avg("gain"), 9).alias("gain"), F.round(F.avg("split"), 9).alias("split"))


def correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with the target, in one pass."""
    row = df.agg(*[F.round(F.corr(F.col(c).cast("double"), F.col(target).cast("double")), 6).alias(c) for c in columns])
    return row.unpivot([], list(columns), "name", "corr")


def bounding_box(points: DataFrame) -> DataFrame:
    """Extent, span, area and density of (x, y, z); lon/lat extents are turned to metres approximately."""
    box = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))
    lonlat = (F.greatest(F.abs("min_x"), F.abs("max_x")) <= 180) & (F.greatest(F.abs("min_y"), F.abs("max_y")) <= 90)
    mid = (F.col("min_y") + F.col("max_y")) / 2
    width = (F.col("max_x") - F.col("min_x")) * F.when(lonlat, 111320 * F.cos(F.radians(mid))).otherwise(1.0)
    height = (F.col("max_y") - F.col("min_y")) * F.when(lonlat, 111000.0).otherwise(1.0)
    return box.withColumns({"lonlat": lonlat, "width": F.round(width, 6), "height": F.round(height, 6), "area": F.round(width * height, 6), "density": F.round(F.col("n") / (width * height), 9)})


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins over the range, the last closed on both sides; empty bins are absent."""
    x = F.col(c).cast("double")
    edge = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    place = F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    return df.filter(F.col(c).isNotNull()).crossJoin(F.broadcast(edge)).select(F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(place).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # one row on the right


def percentiles(df: DataFrame, c: str, shares: Sequence[float], where: Column | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, of the rows for which the condition holds."""
    names = {f"p{round(s * 100):02d}": s for s in shares}
    return exact_percentiles(df if where is None else df.filter(where), c, names).select(*[F.round(n, 6).alias(n) for n in names])


def shares_above(df: DataFrame, c: str, limits: Sequence[float]) -> DataFrame:
    return df.agg(*[F.round(F.avg((F.col(c) > t).cast("double")), 9).alias(f"above_{str(t).replace('.', '_')}") for t in limits])


def compare(df: DataFrame, a: str, b: str) -> DataFrame:
    """Differences of two prediction columns (sample deviation)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return df.agg(
        F.round(F.avg(y) - F.avg(x), 6).alias("d_mean"), F.round(F.stddev_samp(y) - F.stddev_samp(x), 6).alias("d_std"), F.min(x).alias("min_a"), F.max(x).alias("max_a"),
        F.min(y).alias("min_b"), F.max(y).alias("max_b"), F.round(F.corr(x, y), 6).alias("corr"),
    )
