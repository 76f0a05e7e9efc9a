"""Error and ranking metrics as aggregate expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import _running


def smape(y: str | Column, p: str | Column, zero: str = "zero") -> Column:
    """Percent; rows with a zero denominator count as 0 (zero), are left out (skip), or get 1e-8 in it (eps)."""
    y, p = (F.col(x) if isinstance(x, str) else x for x in (y, p))
    d = (F.abs(y) + F.abs(p)) / 2
    if zero == "eps":
        return F.avg(F.abs(y - p) / (d + 1e-8)) * 100
    term = F.when(d > 0, F.abs(y - p) / d)
    return F.avg(term if zero == "skip" else F.when(d.isNotNull(), F.coalesce(term, F.lit(0.0)))) * 100


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def log_loss(y: str, p: str, eps: float = 1e-15, n: str | None = None) -> Column:
    """n: a column of how many equal rows a row stands for."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    term = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    return F.sum(term * F.col(n)) / F.sum(n) if n else F.avg(term)


def auc(df: DataFrame, y: str, p: str, n: str | None = None) -> DataFrame:
    """One row: auc (ties averaged) and gini = 2 auc - 1, from rank sums over distinct scores. n: a column of how many equal rows a row stands for."""
    many = F.col(n) if n else F.lit(1)
    own = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).select(p, many.alias("m"), (F.col(y).cast("long") * many).alias("pos"))
    by = own.groupBy(p).agg(F.sum("m").alias("n"), F.sum("pos").alias("pos"))
    places = _running(by, p, "n", "pos").select("n", "pos", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    sums = places.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), F.sum(F.col("n") - F.col("pos")).alias("n0"))
    value = (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
    return sums.select(F.round(value, 9).alias("auc"), F.round(2 * value - 1, 9).alias("gini"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: sum of recall steps times precision over distinct scores, from the highest."""
    by = df.groupBy((-F.col(p)).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count("*").alias("n"))
    both = _running(by, "s", "n", "tp").select("s", "n", "tp", (F.col("before_n") + F.col("n")).alias("cum_n"), (F.col("before_tp") + F.col("tp")).alias("cum_tp"))
    total = by.agg(F.sum("tp").alias("t"))
    step = both.crossJoin(F.broadcast(total))  # one row on the right
    return step.agg(F.round(F.sum(F.col("tp") / F.col("t") * F.col("cum_tp") / F.col("cum_n")), 9).alias("average_precision"))


def mean_average_precision(df: DataFrame, key: str, y: str, p: str, tie: str) -> DataFrame:
    """One row: the mean over keys with a relevant row of their average precision."""
    w = Window.partitionBy(key).orderBy(F.desc(p), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = df.withColumns({"__r": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(p), tie)), "__h": F.sum(F.col(y).cast("long")).over(w)})
    own = hits.filter(F.col(y) == 1).groupBy(key).agg(F.avg(F.col("__h") / F.col("__r")).alias("ap"))
    return own.agg(F.round(F.avg("ap"), 9).alias("map"), F.count("*").alias("keys"))


def consistency(y_log: str, price: str, confident: Column) -> Column:
    """Mean absolute log difference on confident rows."""
    return F.avg(F.when(confident, F.abs(F.log1p(F.col(price)) - F.col(y_log))))


def checks(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean shift below 5, no negative value, correlation above 0.99: one row for each check."""
    row = df.agg(F.abs(F.avg(b) - F.avg(a)).alias("mean_shift"), F.min(b).alias("minimum"), F.corr(a, b).alias("correlation"))
    long = row.select(*[F.col(c).cast("double") for c in row.columns]).unpivot([], row.columns, "check", "value")
    ok = F.when(F.col("check") == "mean_shift", F.col("value") < 5).when(F.col("check") == "minimum", F.col("value") >= 0).otherwise(F.col("value") > 0.99)
    return long.select("check", F.round("value", 6).alias("value"), F.coalesce(ok, F.lit(False)).alias("pass"))
