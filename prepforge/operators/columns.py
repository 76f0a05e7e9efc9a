"""Projections and row predicates: pruning, casts, imputation with flags, clipping, target transforms, layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a missing value of each role.
FILL = {"text": "", "numeric": -1, "count": 0, "categorical": "unknown", "flag": 0, "url": ""}


def features_only(df: DataFrame, *drop: str) -> DataFrame:
    return df.drop(*drop)


def keep_present(df: DataFrame, keep: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """The listed columns that exist, after renaming."""
    for old, new in (rename or {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*[c for c in keep if c in df.columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def cast_declared(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Declared types; what cannot be read becomes null, and null stays null."""

    def one(c: str, kind: str) -> Column:
        if kind == "timestamp_ntz":
            return F.try_to_timestamp(F.col(f"`{c}`").cast("string")).cast("timestamp_ntz")
        return F.col(f"`{c}`").try_cast(kind)

    return df.withColumns({c: one(c, k) for c, k in kinds.items() if c in df.columns})


def without_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def impute(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """<col>_is_missing flags and fills by role (text, numeric, count, categorical, flag, url); flags columns get no flag of their own."""
    new: dict[str, Column] = {}
    for c, role in roles.items():
        if c not in df.columns:
            continue
        if role != "flag":
            new[f"{c}_is_missing"] = F.col(c).isNull().cast("int")
        new[c] = F.coalesce(F.col(c), F.lit(FILL[role])) if role != "flag" else F.coalesce(F.col(c), F.lit(0)).cast("int")
    return df.withColumns(new)


def sparse_columns(df: DataFrame, share: float = 0.5) -> list[str]:
    """Columns of which more than this share is missing: one aggregate over all columns, learned on training rows."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] is not None and row[c] > share]


def clip(c: Column | str, low: float, high: float) -> Column:
    """Between low and high; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def to_log(c: str) -> Column:
    return F.log1p(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0))))


def from_log(c: str | Column, safe: bool = False) -> Column:
    """expm1; safe clips the logarithm to [-5, 12] and the result to 0 and above."""
    c = F.col(c) if isinstance(c, str) else c
    return F.greatest(F.expm1(clip(c, -5, 12)), F.lit(0.0)) if safe else F.expm1(c)


def product(a: str, b: str) -> Column:
    return F.col(a) * F.col(b)


def ratio(a: str, b: str) -> Column:
    """a / (b + 1e-5), null where b is."""
    return F.when(F.col(b).isNotNull(), F.col(a) / (F.col(b) + 1e-5))


def missing_flag(c: str) -> Column:
    return F.col(c).isNull().cast("int")


def round_score(c: str, places: int = 6) -> Column:
    """Half to even, as numpy rounds."""
    return F.bround(c, places)


def tag(df: DataFrame, split: str) -> DataFrame:
    return df.withColumn("split", F.lit(split))


def align(df: DataFrame, layout: Sequence[str], fill: float = 0.0) -> DataFrame:
    """The training layout: missing columns and values become fill, further columns go."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) if c in df.columns else F.lit(fill).alias(c) for c in layout])


def fuse(df: DataFrame, blocks: Sequence[str], out: str = "features") -> DataFrame:
    """One vector of named columns and vector columns; names stay in the column's metadata."""
    return VectorAssembler(inputCols=list(blocks), outputCol=out, handleInvalid="keep").transform(df)


def feature_names(df: DataFrame, vector: str = "features") -> list[str]:
    """Names of a fused vector's places, f_<i> where none is stored."""
    attrs = df.schema[vector].metadata.get("ml_attr", {})
    named = {a["idx"]: a.get("name", f"f_{a['idx']}") for group in attrs.get("attrs", {}).values() for a in group}
    return [named.get(i, f"f_{i}") for i in range(attrs.get("num_attrs", len(named)))]


def slice_features(df: DataFrame, names: Sequence[str], vector: str = "features", out: str = "picked") -> DataFrame:
    return VectorSlicer(inputCol=vector, outputCol=out, names=list(names)).transform(df)


def ensure_family(df: DataFrame, names: Sequence[str], fill: float = 0) -> DataFrame:
    """Columns of a family exist, with fill where they were absent or null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) if c in df.columns else F.lit(fill) for c in names})
