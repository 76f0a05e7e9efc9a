"""Joins: as-of, per-key history, expansion to slots, map look-ups, alignment by key, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .ranks import ranges

#: A look-up table is broadcast up to so many rows, counted first; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: A key of an as-of join is cut into time ranges from so many rows on, if that is more than a partition's share.
SHARE_ROWS = 1_000_000


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, take: Sequence[str], tie: str | None = None, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Backward as-of join: each left row with the latest right row of its key at or before its time (exact matches count).

    Both sides are united and sorted once by key and time, right rows first, and the last right row is carried forward; no pair of rows is
    built. Keys that hold more than a partition's share of all rows (and more than share_rows) are cut into time ranges, and the last right
    row of a range is carried to the next ones. Of right rows at one time the last by tie counts. Left rows without key, time or match keep
    nulls; right rows without them match nothing.
    """
    values = [f"{right_on}", *[c for c in take if c != right_on]]
    a = left.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    kind = a.schema["__row"].dataType
    order = F.col(tie) if tie else F.lit(0)
    ls = a.select(F.col(by).alias("__k"), F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(order.alias("o")).dtypes[0][1]).alias("__tie"), "__row")
    payload = F.struct(*[F.col(f"`{c}`") for c in values])
    rs = right.filter(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(F.col(by).alias("__k"), F.col(right_on).alias("__t"), F.lit(0).alias("__side"), order.alias("__tie"), payload.alias("__p"))
    both = rs.withColumn("__row", F.lit(None).cast(kind)).unionByName(ls.withColumn("__p", F.lit(None).cast(rs.schema["__p"].dataType)))
    places = [F.col("__t").asc_nulls_last(), F.col("__side"), F.col("__tie")]
    last = lambda *keys: F.when(F.col("__t").isNotNull() & F.col("__k").isNotNull(), F.last("__p", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*places).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hot = _hot_keys(both, share_rows)
    if hot is None:
        out = both.withColumn("__m", last("__k")).filter("__side = 1")
    else:
        cold = both.join(F.broadcast(hot), both["__k"].eqNullSafe(hot["__hot"]), "left_anti")  # fewer keys than partitions
        out = cold.withColumn("__m", last("__k")).filter("__side = 1").select("__row", "__m").unionByName(_carried(both.join(F.broadcast(hot), both["__k"].eqNullSafe(hot["__hot"]), "left_semi"), places, last))
    names = {c: (c if c not in left.columns else f"{c}_right") for c in values}
    return out.select("__row.*", *[F.col(f"__m.{c}").alias(names[c]) for c in values])


def _hot_keys(rows: DataFrame, share_rows: int) -> DataFrame | None:
    """Keys of more rows than share_rows and a partition's share: fewer than there are partitions."""
    n = ranges(rows)
    counts = rows.groupBy("__k").agg(F.count("*").alias("__n")).filter(F.col("__n") > share_rows)
    counts = durable(counts)
    if counts.isEmpty():
        return None
    share = rows.count() / n
    hot = counts.filter(F.col("__n") > share).select(F.col("__k").alias("__hot"))
    return None if hot.isEmpty() else hot


def _carried(rows: DataFrame, places: list, last) -> DataFrame:
    """__row and __m of the left rows of hot keys: rows lie in time ranges, and a range takes over the last right row before it."""
    ranged = durable(rows.repartitionByRange(ranges(rows), F.col("__k"), *places).withColumn("__part", F.spark_partition_id()))
    order = F.struct("__t", "__side", "__tie")
    ends = ranged.filter("__side = 0").groupBy("__k", "__part").agg(F.max_by("__p", order).alias("__end"))
    pieces = ranged.select("__k", "__part").distinct().join(ends, ["__k", "__part"], "left")  # a row for each hot key and range
    before = pieces.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__k", "__part", "__carry")
    own = ranged.withColumn("__m", last("__k", "__part")).filter("__side = 1").join(F.broadcast(before), ["__k", "__part"], "left")
    return own.select("__row", F.when(F.col("__t").isNotNull(), F.coalesce("__m", "__carry")).alias("__m"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else df."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def left_history(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return rows.join(history, key, "left")


def expand_slots(keys: DataFrame, key: str, slots: int = 28) -> DataFrame:
    """Every distinct key with every slot."""
    return keys.select(key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots))))


def look_up(df: DataFrame, column: str, table: DataFrame, key: str, value: str, default, out: str) -> DataFrame:
    """Map look-up with a default; the table is broadcast if small."""
    t = table.select(F.col(key).alias(column), F.col(value).alias(out))
    return df.join(small(t), column, "left").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def realign(base: DataFrame, block: DataFrame, key: str) -> DataFrame:
    """A block joined by key; an error if a base row lacks its vector."""
    out = base.join(block, key, "left")
    value = next(c for c in block.columns if c != key)
    lost = out.filter(F.col(value).isNull()).limit(1).count()
    if lost:
        raise ValueError("the block is shorter than the table it is aligned with")
    return out


def mismatches(a: DataFrame, b: DataFrame, key: str, *values: str) -> DataFrame:
    """Alignment check of two tables: rows in one only, and keys with different values."""
    x = a.select(key, F.struct(*values).alias("x"))
    y = b.select(key, F.struct(*values).alias("y"))
    j = x.join(y, key, "full")
    return j.agg(
        F.count(F.when(F.col("y").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_right"),
        F.count(F.when(F.col("x") != F.col("y"), 1)).alias("different"),
    )


def stack(*parts: DataFrame) -> DataFrame:
    """Union all by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_pseudo(labelled: DataFrame, pseudo: DataFrame, weight: float = 0.5) -> DataFrame:
    """Labelled rows at weight 1 and pseudo-labelled rows at weight."""
    return labelled.withColumn("weight", F.lit(1.0)).unionByName(pseudo.withColumn("weight", F.lit(weight)))
