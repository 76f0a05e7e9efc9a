"""Vector columns (arrays of numbers): cosine, cross-modal blocks, normalising, pooling, PCA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """a.b / (|a||b| + 1e-8)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def cross_modal(a: str, b: str, name: str) -> dict[str, Column]:
    """Cosine, both norms, and their ratio."""
    x, y = F.col(a), F.col(b)
    return {f"{name}_cos": cosine(x, y), f"{name}_norm_a": norm(x), f"{name}_norm_b": norm(y), f"{name}_norm_ratio": norm(x) / (norm(y) + 1e-8)}


def all_cross_modal(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The blocks of all pairs whose columns exist; a zero column if there is none."""
    found = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    if not found:
        return df.withColumn("cross_none", F.lit(0.0))
    return df.withColumns({k: v for a, b in found for k, v in cross_modal(a, b, f"{a}_{b}").items()})


def cosine_by_size(cos: str, pack_value: str) -> Column:
    return F.col(cos) * F.log1p(F.greatest(F.coalesce(F.col(pack_value).cast("double"), F.lit(0.0)), F.lit(0.0)))


def unit(a: str | Column) -> Column:
    """Length 1; a zero vector stays as it is (the length is at least 1e-12)."""
    a = F.col(a) if isinstance(a, str) else a
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def masked_mean(tokens: DataFrame, doc: str, vector: str, mask: str) -> DataFrame:
    """Mean of the token vectors with mask 1, for each document; zeros if none."""
    flat = tokens.select(doc, F.posexplode(vector).alias("pos", "v"), F.col(mask).cast("double").alias("m"))
    mean = flat.groupBy(doc, "pos").agg((F.sum(F.col("v") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("v"))
    return mean.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p")).select(doc, F.transform("p", lambda x: x.v).alias(vector))


class CentredPca:
    """PCA fitted on training rows; the mean is taken off first, which Spark's PCA does not do when it transforms."""

    def __init__(self, train: DataFrame, vector: str, k: int, scale: bool = False):
        self.vector = vector
        flat = train.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # one row a dimension
        self.mean = [r.m for r in flat]
        self.std = [(r.s or 1.0) if scale else 1.0 for r in flat]
        self.model = PCA(k=k, inputCol="__c", outputCol="__p").fit(self._centred(train))
        self.explained = [float(x) for x in self.model.explainedVariance]

    def _centred(self, df: DataFrame) -> DataFrame:
        centre = F.array(*map(F.lit, self.mean))
        std = F.array(*map(F.lit, self.std))
        shifted = F.zip_with(F.col(self.vector).cast("array<double>"), centre, lambda x, m: x - m)
        return df.withColumn("__c", array_to_vector(F.zip_with(shifted, std, lambda x, s: x / s)))

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        return self.model.transform(self._centred(df)).withColumn(out, vector_to_array("__p")).drop("__c", "__p")

    def with_error(self, df: DataFrame, out: str) -> DataFrame:
        """The components and the root mean square of what they leave."""
        pc = self.model.pc.toArray()
        p = self.model.transform(self._centred(df)).withColumns({"__v": vector_to_array("__c"), out: vector_to_array("__p")})
        back = F.array(*[sum((F.col(out)[j] * float(pc[i, j]) for j in range(pc.shape[1])), F.lit(0.0)) for i in range(pc.shape[0])])
        gap = F.zip_with("__v", back, lambda x, y: (x - y) * (x - y))
        rmse = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / pc.shape[0])
        return p.withColumn(f"{out}_rmse", rmse).drop("__c", "__p", "__v")
