"""Ranks, bins, codes and top-k: window functions that don't pull a table into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

By = Sequence[str]


def ranges(df: DataFrame) -> int:
    """As many ranges as the session shuffles into, which is set by the size of its tables."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str, rows: int = 100_000) -> DataFrame:
    """df dealt out by keys over all cores, and over more partitions where these would hold more than rows on average: a compact file may come as one partition, or as few with many rows each."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def _running(values: DataFrame, v: str, *ns: str) -> DataFrame:
    """Rows before each distinct value (before, or before_<n> for several counts): values are range-partitioned once, and sums of whole ranges give each its offset."""
    ranged = durable(values.repartitionByRange(ranges(values), v).withColumn("__part", F.spark_partition_id()))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = ranged.groupBy("__part").agg(*[F.sum(n).alias(n) for n in ns])
    offsets = parts.select("__part", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"__o_{n}") for n in ns])
    inside = Window.partitionBy("__part").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    names = ["before"] if len(ns) == 1 else [f"before_{n}" for n in ns]
    before = [(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"__o_{n}")).alias(name) for n, name in zip(ns, names, strict=True)]
    return ranged.join(F.broadcast(offsets), "__part").select(v, *ns, *before)


#: Tables of more rows are narrowed to the neighbourhood of the wanted order statistics first.
DIRECT_ROWS = 200_000
#: Half the width of that neighbourhood, as a share of the rows: several times the error of the sketch that finds it.
NEAR, SKETCH = 0.002, 2000


def exact_percentiles(df: DataFrame, c: str, cuts: Mapping[str, float], by: By = (), direct: int = DIRECT_ROWS, number: str | None = None) -> DataFrame:
    """by and a column for each of cuts (name to share): exact percentiles with linear interpolation of the values that are not null.

    Distributed selection: counted values are range-partitioned; the counts of ranges tell which range holds an order statistic, and only
    these ranges are looked into. No task holds more than a range. Of tables with more than direct rows only values near the wanted places
    are counted: a sketch tells where these begin and end, and exact counts tell how many values lie before, and that the places are within.
    number: a column of how many equal rows a row stands for; such rows are not narrowed.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0))  # of structs, nulls are equal in joins
    values = df.filter(F.col(c).isNotNull()).select(key.alias("__k"), F.col(c).cast("double").alias("__v"), (F.col(number) if number else F.lit(1)).alias("__m"))
    near = _near_places(values, cuts) if number is None and values.count() > direct else None
    ends = lambda name, share: [F.struct(F.lit(name).alias("name"), F.lit(low).alias("low"), (F.floor if low else F.ceil)((F.col("__all") - 1) * F.lit(float(share))).cast("long").alias("at"), ((F.col("__all") - 1) * F.lit(float(share))).alias("place")) for low in (True, False)]
    if near is None:
        counted = values.groupBy("__k", "__v").agg(F.sum("__m").alias("__n"))
        sizes = None
        own = ["__k"]
    else:
        # the rows near a place, for each cut
        from .joins import small

        within = values.join(small(near), "__k").withColumn("__c", F.explode("__cuts")).filter((F.col("__v") >= F.col("__c.lo")) & (F.col("__v") <= F.col("__c.hi")))
        counted = within.groupBy("__k", F.col("__c.name").alias("__cut"), "__v").agg(F.count("*").alias("__n"))
        sizes = near.withColumn("__c", F.explode("__cuts")).select("__k", F.col("__c.name").alias("__cut"), F.col("__n").alias("__all"), F.col("__c.below").alias("__below"))
        own = ["__k", "__cut"]
    ranged = durable(counted.repartitionByRange(ranges(df), *own, "__v").withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy(*own, "__part").agg(F.sum("__n").alias("__s"))
    whole, upto = Window.partitionBy(*own), Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.withColumn("__o", F.coalesce(F.sum("__s").over(upto), F.lit(0)))
    if sizes is None:
        parts = parts.withColumn("__all", F.sum("__s").over(whole)).withColumn("e", F.explode(F.array(*[e for n, x in cuts.items() for e in ends(n, x)])))
    else:
        parts = parts.join(small(sizes), own).withColumn("__o", F.col("__o") + F.col("__below")).withColumn("e", F.explode(F.array(*[e for n, x in cuts.items() for e in ends(n, x)]))).filter("e.name = __cut")
    wanted = durable(parts.filter((F.col("e.at") >= F.col("__o")) & (F.col("e.at") < F.col("__o") + F.col("__s"))).select(*own, "__part", "__o", "e.*"))
    keys = [*own, "__part"]
    some = wanted.select(*keys).distinct()
    held = ranged.join(some if by else F.broadcast(some), keys, "left_semi")
    inside = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__w", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    hit = held.join(wanted, keys).filter((F.col("at") >= F.col("__o") + F.col("__w")) & (F.col("at") < F.col("__o") + F.col("__w") + F.col("__n")))
    value = lambda name, low: F.max(F.when((F.col("name") == name) & (F.col("low") == low), F.col("__v")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("place") - F.floor("place")))
    between = lambda lo, hi, w: F.when(lo == hi, lo).otherwise(lo * (1 - w) + hi * w)
    found = [between(value(n, True), value(n, False), share(n)).alias(n) for n in cuts]
    return hit.groupBy("__k").agg(*found).select("__k.*", *cuts) if by else hit.agg(*found)


def _near_places(values: DataFrame, cuts: Mapping[str, float]) -> DataFrame | None:
    """For each key its number of values and, for each cut, an interval of values (lo, hi) that holds the wanted places, with the number of values before it; None where the sketch missed one."""
    from .joins import small

    shares = [max(0.0, min(1.0, x + d)) for x in cuts.values() for d in (-NEAR, NEAR)]
    sketch = values.groupBy("__k").agg(F.count("*").alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, shares)), F.lit(SKETCH)).alias("__e"))
    edge = lambda i, high: F.lit(float("nan" if high else "-inf")) if shares[i] in (0.0, 1.0) else F.col("__e")[i]  # noqa: E731  not a number is the largest value
    sketch = durable(sketch.select("__k", "__n", *[f.alias(f"__{n}{i}") for i in range(len(cuts)) for n, f in (("lo", edge(2 * i, False)), ("hi", edge(2 * i + 1, True)))]))
    counts = [F.count(F.when(test, 1)).alias(f"__{n}{i}") for i in range(len(cuts)) for n, test in (("below", F.col("__v") < F.col(f"__lo{i}")), ("upto", F.col("__v") <= F.col(f"__hi{i}")))]
    known = durable(values.join(small(sketch), "__k").groupBy("__k").agg(*counts).join(small(sketch), "__k"))
    place = lambda share: (F.col("__n") - 1) * F.lit(float(share))
    missed = [(F.floor(place(x)) < F.col(f"__below{i}")) | (F.ceil(place(x)) >= F.col(f"__upto{i}")) for i, x in enumerate(cuts.values())]
    if not known.filter(F.array_contains(F.array(*missed), True)).isEmpty():  # noqa: FBT003
        return None
    return known.select("__k", "__n", F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"__lo{i}").alias("lo"), F.col(f"__hi{i}").alias("hi"), F.col(f"__below{i}").alias("below")) for i, n in enumerate(cuts)]).alias("__cuts"))


def average_ranks(df: DataFrame, c: str, number: str | None = None) -> DataFrame:
    """Distinct values of c (not null) with n, rows before, and the average-tie rank. number: a column of how many equal rows a row stands for."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg((F.sum(number) if number else F.count("*")).alias("n"))
    return _running(counts, c, "n").select(c, "n", "before", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def percent_rank_average(df: DataFrame, c: str, out: str, number: str | None = None) -> DataFrame:
    """Average-tie rank over the number of rows, nulls included in it and kept as null. number: as in average_ranks."""
    total = (df.agg(F.sum(number)).first()[0] or 0) if number else df.count()
    ranks = average_ranks(df, c, number).select(c, (F.col("rank") / total).alias(out))
    return df.join(ranks, c, "left")


def rank_slots(scores: DataFrame, key: str, slot: str, score: str) -> DataFrame:
    """Slots of each key by falling score (a slot's best counts, ties to the smaller slot), as labels slot_<n>."""
    best = scores.groupBy(key, slot).agg(F.max(score).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), F.col(slot).alias("slot"))))
    return best.groupBy(key).agg(F.transform(ordered, lambda x: F.concat(F.lit("slot_"), x.slot.cast("string"))).alias("slots"))


def cumulative_share(gains: DataFrame, share: float = 0.8) -> DataFrame:
    """Features by falling gain with the running share, and whether that is within share (a table of one row a feature)."""
    order = Window.orderBy(F.desc("gain"), "feature").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = gains.agg(F.sum("gain").alias("t"))
    out = gains.crossJoin(F.broadcast(total)).withColumn("cum", F.round(F.sum("gain").over(order) / F.col("t"), 9)).drop("t")
    return out.withColumn("kept", F.col("cum") <= share)


def quantile_bins(df: DataFrame, c: str, q: int, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 0; equal edges count once; null stays null."""
    shares = [i / q for i in range(q + 1)]
    found = exact_percentiles(df, c, {f"e{i}": x for i, x in enumerate(shares)}).first()
    edges = sorted({e for e in found if e is not None})
    inner = edges[1:-1]
    x = F.col(c).cast("double")
    place = sum((F.when(x > e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(out, F.when(x.isNotNull(), place).cast("int"))


def category_codes(train: DataFrame, c: str) -> DataFrame:
    """One code for each value in sorted order, fitted once: (value, code)."""
    values = train.filter(F.col(c).isNotNull()).select(c).distinct()
    return _running(values.withColumn("n", F.lit(1)), c, "n").select(F.col(c).alias("value"), F.col("before").cast("int").alias("code"))


def encode_category(df: DataFrame, codes: DataFrame, c: str, out: str) -> DataFrame:
    """Missing and unseen values get -1."""
    from .joins import small

    return df.join(small(codes.select(F.col("value").alias(c), F.col("code").alias(out))), c, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def spaced_top(cells: DataFrame, value: str, k: int, apart: float, by: By = ()) -> DataFrame:
    """Greedy top-k of each grid's (row, col, value): each more than apart cells from those before; ties to the smaller row, then column.

    A cell that is better than the k-th pick is a pick or lies within apart of one, so the picks are among the best (k - 1) discs of cells
    and one more, a number that the parameters give. One range partition finds these; each grid's are merged greedily in one task.
    """
    reach = int(apart)
    disc = sum(1 for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if np.hypot(r, c) <= apart)
    most = (k - 1) * disc + 1
    own = cells.filter(F.col(value).isNotNull()).select(*by, "row", "col", F.col(value).cast("double").alias(value))
    order = [F.desc(value), "row", "col"]
    ranged = durable(own.repartitionByRange(ranges(cells), *by, *order).withColumn("__part", F.spark_partition_id()))
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(upto), F.lit(0))).filter(F.col("__o") < most)
    best = ranged.join(parts, [*by, "__part"]).withColumn("__i", F.col("__o") + F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))).filter(F.col("__i") <= most)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        row, col, left, picks = pdf["row"].to_numpy(), pdf["col"].to_numpy(), np.ones(len(pdf), bool), []
        while left.any() and len(picks) < k:
            i = int(np.argmax(left))
            picks.append(i)
            left &= np.hypot(row - row[i], col - col[i]) > apart
        out = pdf.iloc[picks][[*by, "row", "col", value]].copy()
        out["pick"] = np.arange(1, len(picks) + 1)
        return out

    kinds = dict(own.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + f"row int, col int, `{value}` double, pick int"
    found = best.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value, "__i").groupBy(*by).applyInPandas(greedy, schema)
    return found.select(*by, "pick", "row", "col", value)


def lowest_border(cells: DataFrame, value: str = "value", by: By = ()) -> DataFrame:
    """The lowest cell of each grid's border (row, col from 0): top, bottom, left, right, in this order among equals."""
    from .joins import small

    size = cells.groupBy(*by).agg(F.max("row").alias("h"), F.max("col").alias("w"))
    full = cells.filter(F.col(value).isNotNull())
    c = full.join(small(size), list(by)) if by else full.crossJoin(F.broadcast(size))  # one row for each grid
    side = F.when(F.col("row") == 0, 0).when(F.col("row") == F.col("h"), 1).when(F.col("col") == 0, 2).when(F.col("col") == F.col("w"), 3)
    at = F.when(side < 2, F.col("col")).otherwise(F.col("row"))
    edge = c.withColumn("side", side).filter("side is not null").withColumn("at", at)
    return edge.groupBy(*by).agg(F.min_by(F.struct("row", "col", F.col(value).alias("z")), F.struct(F.col(value), "side", "at")).alias("m")).select(*by, "m.*")


def exact_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, picked by a hash of the key: the same rows whatever the partitions."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def share_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)
