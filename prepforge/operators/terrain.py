"""Grids as cell tables (row, col, value): rasterising, filling, smoothing, hydrology, hot spots, routes.

Local operators work on blocks of cells (`stencils`); depressions, accumulation and least cost are in `rims`.

A table may hold the grids of many villages. `by` names the columns that tell them apart; all groupings have them. Where an operator needs
the number of rows and columns, it takes them as numbers, or as the names of columns of by that hold them for each village.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable
from .joins import small
from .ranks import exact_percentiles, lowest_border, spaced_top
from .rims import COST_FAN, TILE, Tiles, block_side, distance_blocks, fill_depressions, flow_accumulation, least_cost, settled_rims, tiled  # noqa: F401
from .spatial import NEIGHBOURS, cell_index, grid_meta, nearest_filled
from .stencils import REACH, Block, cell_percentiles, near_filled, number, on_blocks, smoothed, sobel, steepest

By = Sequence[str]


def per_grid(cells: DataFrame, summary: DataFrame, by: By) -> DataFrame:
    """cells with the columns of summary, one row for each grid."""
    return cells.join(small(durable(summary)), list(by)) if by else cells.crossJoin(F.broadcast(summary))


def rasterise(indexed: DataFrame, stat: str = "mean", by: By = ()) -> DataFrame:
    """row, col, value from (row, col, z): mean, min, median, p05 or p10 (exact, interpolated)."""
    return rasterise_all(indexed, stat, by=by).withColumnRenamed(stat, "value")


def rasterise_all(indexed: DataFrame, *stats: str, by: By = ()) -> DataFrame:
    """row, col and a column for each of stats, in one pass."""
    z = F.col("z").cast("double")
    at = [*by, "row", "col"]
    if all(s in SHARES for s in stats):
        return cell_percentiles(indexed.select(*at, z.alias("z")), {s: SHARES[s] for s in stats}, by)
    values = {"mean": F.avg(z), "min": F.min(z), "median": F.median(z), "p05": F.percentile(z, 0.05), "p10": F.percentile(z, 0.10)}
    return indexed.groupBy(*at).agg(*[values[s].alias(s) for s in stats])


#: Shares of the exact percentiles.
SHARES = {"median": 0.5, "p05": 0.05, "p10": 0.10}


def ground_labels(indexed: DataFrame, threshold: float = 0.5) -> DataFrame:
    """label 2 (ground) where z is at most threshold above the lowest point of the 3 x 3 cells around, else 1."""
    low = indexed.groupBy("row", "col").agg(F.min("z").alias("z"))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = low.withColumn("dr", step).withColumn("dc", step)
    base = around.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(F.min("z").alias("__low"))
    return indexed.join(base, ["row", "col"]).withColumn("label", F.when(F.col("z") - F.col("__low") <= threshold, 2).otherwise(1)).drop("__low")


def full_grid(spark, nrows: int, ncols: int) -> DataFrame:
    return spark.range(nrows * ncols).select(F.floor(F.col("id") / ncols).cast("int").alias("row"), F.pmod("id", F.lit(ncols)).cast("int").alias("col"))


def all_cells(grids: DataFrame, nrows: int | str, ncols: int | str, by: By = ()) -> DataFrame:
    """Every cell of each grid (by, and one row for each): rows first, dealt out, then columns."""
    rows = grids.select(*by, F.explode(F.sequence(F.lit(0), number(nrows) - 1)).alias("row"))
    return rows.repartition(*by, "row").withColumn("col", F.explode(F.sequence(F.lit(0), number(ncols) - 1))).select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def fill_gaps(cells: DataFrame, nrows: int | str, ncols: int | str, method: str = "idw", k: int = 8, power: float = 2.0, by: By = ()) -> DataFrame:
    """Every cell of the grid; empty ones get the nearest filled value, or the inverse-distance mean of the k nearest."""
    known = cells.filter(F.col("value").isNotNull()).select(*by, "row", "col", F.col("value").cast("double").alias("value"))
    many = 1 if method == "nearest" else k

    def fill(b: Block):
        values, filled, far = near_filled(b, "value", many, power)
        return filled | far, {"value": np.ma.array(values, mask=~filled)}

    # most empty cells find k filled ones nearby, within their block; only those that don't are looked for from afar
    sized = known if by else known.select("row", "col", "value")
    made = durable(on_blocks(sized, ["value"], nrows, ncols, REACH, fill, "value double", by, every=True))
    far = made.filter("value is null").select(*by, "row", "col")
    if far.isEmpty():
        return made
    w = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-6)), F.lit(power))
    near = nearest_filled(far, known, many, by=by)
    values = near.groupBy(*by, "row", "col").agg((F.sum(w * F.col("n_value")) / F.sum(w)).alias("value"))
    return made.filter("value is not null").unionByName(values)


def gaussian_weights(sigma: float) -> dict[int, float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return {i - r: x / sum(w) for i, x in enumerate(w)}


def gaussian(cells: DataFrame, nrows: int | str, ncols: int | str, sigma: float, value: str = "value", by: By = ()) -> DataFrame:
    weights = gaussian_weights(sigma)
    return smoothed(cells, nrows, ncols, (("row", weights), ("col", weights)), value, "value", by)


def slope(cells: DataFrame, nrows: int | str, ncols: int | str, cell: float, floor: float = 0.0, by: By = ()) -> DataFrame:
    """Sobel gradient over 8 cells, its magnitude, at least floor."""

    def f(b: Block):
        v, here = sobel(b, "value", cell, floor)
        return here, {"slope": v}

    return on_blocks(cells, ["value"], nrows, ncols, 1, f, "slope double", by)


def roughness(cells: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """One row: mean length of the differences to the right and lower neighbour, missing ones as 0."""
    right, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    dense = full_grid(cells.sparkSession, nrows, ncols).join(cells, ["row", "col"], "left")
    d = dense.withColumns({"dx": F.coalesce(F.lead("value").over(right) - F.col("value"), F.lit(0.0)), "dy": F.coalesce(F.lead("value").over(down) - F.col("value"), F.lit(0.0))})
    inner = d.filter((F.col("row") < nrows - 1) & (F.col("col") < ncols - 1))
    return inner.agg(F.round(F.avg(F.hypot("dx", "dy")), 6).alias("roughness"))


def points_per_cell(indexed: DataFrame, n_cells: int) -> DataFrame:
    """Coverage and the spread of points over cells that have any."""
    n = indexed.groupBy("row", "col").agg(F.count("*").alias("n"))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    row = n.agg(F.count("*").alias("cells"), F.round(100 * F.count("*") / n_cells, 6).alias("coverage_pct"), F.min("n").alias("min"), p.alias("p"), F.max("n").alias("max"))
    return row.select("cells", "coverage_pct", "min", *[F.floor(F.col("p")[i]).cast("long").alias(c) for i, c in enumerate(("p50", "p90", "p99"))], "max", (F.floor(F.col("p")[0]) <= 1).alias("sparse"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).select("row", "col", (F.col("value") - F.col("other")).alias("value"))


def leakage_share(median: DataFrame, low: DataFrame, limit: float = 2.0) -> DataFrame:
    return difference(median, low).agg(F.round(100 * F.avg((F.col("value") > limit).cast("int")), 6).alias("leak_pct"))


def flow_direction(cells: DataFrame, by: By = ()) -> DataFrame:
    """row, col, value, d: the steepest of eight neighbours, the first in code order among equals; border and empty cells keep 0."""
    size = cells.groupBy(*by).agg((F.max("row") + 1).cast("int").alias("__h"), (F.max("col") + 1).cast("int").alias("__w"))
    keys = [*by, "__h", "__w"]

    def f(b: Block):
        return b.own(b.here), {"value": np.ma.array(b.own(b.values["value"]), mask=~b.own(b.full["value"])), "d": steepest(b, "value")}

    return on_blocks(per_grid(cells.select(*by, "row", "col", F.col("value").cast("double").alias("value")), size, by), ["value"], "__h", "__w", 1, f, "value double, d int", keys).select(*by, "row", "col", "value", "d")


def sloped(filled: DataFrame, nrows: int | str, ncols: int | str, cell: float, floor: float = 0.001, by: By = ()) -> DataFrame:
    """row, col, value, slope, d of whole grids: slope and flow direction in one pass."""

    def f(b: Block):
        return b.own(b.here), {"value": b.own(b.values["value"]), "slope": sobel(b, "value", cell, floor)[0], "d": steepest(b, "value")}

    return on_blocks(filled, ["value"], nrows, ncols, 1, f, "value double, slope double, d int", by)


def wet(drained: DataFrame, nrows: int | str, ncols: int | str, cell: float, sigma: float = 2.0, by: By = ()) -> DataFrame:
    """row, col, value, slope, acc and smoothed wetness (twi) of whole grids of value, slope and acc."""
    weights = gaussian_weights(sigma)

    def f(b: Block):
        with np.errstate(all="ignore"):
            v = np.log(b.values["acc"] * cell / np.maximum(b.values["slope"], 0.001))
        v = np.where(b.here & np.isfinite(v), v, 0.0)
        return b.own(b.here), {n: b.own(b.values[n]) for n in ("value", "slope", "acc")} | {"twi": b.weighted((("row", weights), ("col", weights)), v, b.here, b.here)[0]}

    return on_blocks(drained, ["value", "slope", "acc"], nrows, ncols, max(weights), f, "value double, slope double, acc double, twi double", by)


def wetness(acc: DataFrame, slopes: DataFrame, cell: float, sca_mode: str = "published", by: By = ()) -> DataFrame:
    """ln(catchment / slope), slope at least 0.001; catchment is acc * cell (published) or acc * cell ** 2 (area)."""
    sca = F.col("acc") * (cell if sca_mode == "published" else cell**2)
    v = F.log(sca / F.greatest("slope", F.lit(0.001)))
    return acc.join(slopes, [*by, "row", "col"]).select(*by, "row", "col", F.coalesce(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v), F.lit(0.0)).alias("value"))


def hot_spots(twi: DataFrame, slopes: DataFrame, acc: DataFrame, by: By = ()) -> DataFrame:
    """moderate, high and critical flags, and risk 0 to 3 (the later level counts); levels are those of the cell's own grid."""
    at = [*by, "row", "col"]
    return risk_levels(durable(twi.withColumnRenamed("value", "twi").join(slopes, at).join(acc, at)), by)


def risk_levels(t: DataFrame, by: By = ()) -> DataFrame:
    """hot_spots of one table of twi, slope and acc."""
    at = [*by, "row", "col"]
    p = lambda c, least, cuts: exact_percentiles(t.filter(F.col(c) > least), c, cuts, by)
    cut = p("twi", 0, {"t90": 0.9, "t95": 0.95})
    for other in (p("slope", 0, {"s25": 0.25}), p("acc", 1, {"f90": 0.9})):
        cut = cut.join(other, list(by), "full") if by else cut.crossJoin(other)  # one row for each grid
    t = t.join(small(cut), list(by), "left") if by else t.crossJoin(F.broadcast(cut))
    moderate, high = F.coalesce(F.col("twi") >= F.col("t90"), F.lit(False)), F.coalesce(F.col("twi") >= F.col("t95"), F.lit(False))
    critical = moderate & F.coalesce(F.col("slope") < F.col("s25"), F.lit(False)) & F.coalesce(F.col("acc") >= F.col("f90"), F.lit(False))
    risk = F.when(critical, 3).when(high, 2).when(moderate, 1).otherwise(0)
    return t.select(*at, "twi", "slope", "acc", moderate.alias("moderate"), high.alias("high"), critical.alias("critical"), risk.alias("risk"))


def low_lying(cells: DataFrame, share: float = 0.1, by: By = ()) -> DataFrame:
    cut = exact_percentiles(cells, "value", {"__cut": share}, by)
    return per_grid(cells, cut, by).withColumn("low", F.col("value") <= F.col("__cut")).drop("__cut")


def routing_cost(cells: DataFrame, slopes: DataFrame | None, by: By = ()) -> DataFrame:
    """0.4 (1 - height) + 0.6 (1 - slope), both scaled to their range. Without slopes cells has them."""
    t = cells if slopes is None else cells.join(slopes, [*by, "row", "col"])
    box = t.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for c in ("value", "slope") for n, f in (("lo", F.min), ("hi", F.max))])
    t = per_grid(t, box, by)
    scaled = lambda c: F.coalesce((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)), F.lit(0.0))
    return t.select(*by, "row", "col", (0.4 * (1 - scaled("value")) + 0.6 * (1 - scaled("slope"))).alias("cost"))


def trace(cost: DataFrame, dist: DataFrame, starts: DataFrame, tile: int = TILE, by: By = ()) -> DataFrame:
    """path, step, row, col from each start (path, row, col) down to the outlet of its grid."""
    tile = block_side(tile)
    tiles = tiled(cost.join(dist, [*by, "row", "col"]), ["cost", "dist"], by, tile)
    return _walked(lambda wanted: tiles.join(small(wanted), [*by, "br", "bc"], "left_semi").select(*tiles.columns), starts, tile, by)


def _walked(blocks: Callable[[DataFrame], DataFrame], starts: DataFrame, span: int, by: By) -> DataFrame:
    """A round walks every path through one block of span cells on a side, and asks blocks for those (by, br, bc) that paths are in."""
    keys = [*by, "br", "bc"]
    heads = starts.select(*by, F.col("path").cast("int").alias("path"), F.lit(0).alias("step"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    out, kinds = heads, "".join(f"`{c}` {t}, " for c, t in heads.dtypes if c in by)
    names = ["path", "step", "row", "col", "left"]

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            t = Tiles(next(right.itertuples(index=False)), ["cost", "dist"], span)
            c, d = t.layers["cost"], np.where(np.isnan(t.layers["dist"]), np.inf, t.layers["dist"])
            for path, step, row, col in left[["path", "step", "row", "col"]].itertuples(index=False):
                while True:
                    inside = 0 <= row - t.r0 < span and 0 <= col - t.c0 < span
                    if found and found[-1][:2] == (path, step):
                        found[-1] = (*found[-1][:4], not inside)
                    if not inside:
                        break
                    k, y, x = (int(v) for v in t.place(np.int64(row << 32 | col)))
                    if k < 0 or not d[k, y, x] > 0:
                        break
                    ways = [(d[k, y + dr, x + dc] + (c[k, y, x] + c[k, y + dr, x + dc]) / 2 * math.hypot(dr, dc), n) for n, (dr, dc) in enumerate(NEIGHBOURS) if d[k, y + dr, x + dc] < d[k, y, x]]
                    if not ways:
                        raise ValueError(f"path {path} stops at ({row}, {col}): no way on to the outlet")
                    dr, dc = NEIGHBOURS[min(ways)[1]]
                    row, col, step = row + dr, col + dc, step + 1
                    found.append((path, step, row, col, True))
        out = pd.DataFrame(found, columns=names).astype({"path": "int32", "step": "int32", "row": "int32", "col": "int32", "left": "bool"})
        for c in by:
            out[c] = left[c].iloc[0] if len(left) else None
        return out

    while not heads.isEmpty():
        # distances fall with every step, so paths end
        placed = heads.withColumns({"br": F.floor(F.col("row") / span).cast("int"), "bc": F.floor(F.col("col") / span).cast("int")})
        here = blocks(durable(placed.select(*keys).distinct()))
        walked = durable(placed.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInPandas(walk, f"{kinds}path int, step int, row int, col int, left boolean"))
        out = out.unionByName(walked.drop("left"))
        heads = walked.filter("left").drop("left")
    return out.distinct()


def polylines(paths: DataFrame, x_min: float | Column, y_max: float | Column, res: float | Column, by: By = ()) -> DataFrame:
    """path, points (x, y of cell corners, in order) and length in metres."""
    p = paths.select(*by, "path", "step", (x_min + F.col("col") * res).alias("x"), (y_max - F.col("row") * res).alias("y"))
    before = Window.partitionBy(*by, "path").orderBy("step")
    p = p.withColumn("seg", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(before), F.col("y") - F.lag("y").over(before)), F.lit(0.0)))
    line = p.groupBy(*by, "path").agg(F.array_sort(F.collect_list(F.struct("step", "x", "y"))).alias("s"), F.round(F.sum("seg"), 6).alias("length"))
    return line.select(*by, "path", F.transform("s", lambda e: F.struct(e.x.alias("x"), e.y.alias("y"))).alias("points"), "length")


def lengths(lines: DataFrame, by: By = ()) -> DataFrame:
    return lines.groupBy(*by).agg(F.count("*").alias("channels"), F.round(F.sum("length"), 6).alias("total"), F.round(F.avg("length"), 6).alias("mean"), F.min("length").alias("min"), F.max("length").alias("max"))


def drainage(cells: DataFrame, slopes: DataFrame | None, acc: DataFrame, k: int = 10, apart: float = 50.0, tile: int = TILE, by: By = ()) -> DataFrame:
    """path, step, row, col of the cheapest channels from the k main collecting cells of each grid to its lowest border cell."""
    starts = durable(spaced_top(acc, "acc", k, apart, by=by).select(*by, F.col("pick").alias("path"), "row", "col"))
    side = block_side(tile)
    tiles, rims = settled_rims(routing_cost(cells, slopes, by), lowest_border(cells, by=by), side, by)
    # distances within a block are worked out only where a path comes by
    return _walked(lambda wanted: distance_blocks(tiles, rims, wanted, side, by), starts, side * COST_FAN, by)


def hectares(flags: DataFrame, cell: float, by: By = ()) -> DataFrame:
    area = cell * cell / 1e4
    return flags.groupBy(*by).agg(*[F.round(F.sum(F.col(c).cast("int")) * area, 6).alias(f"{c}_ha") for c in ("moderate", "high", "critical")])


def village_checks(metrics: DataFrame) -> DataFrame:
    """Rules on (village, coverage_pct, range, std, paths): one row for each village and rule."""
    rules = {"coverage": F.col("coverage_pct") > 15, "range": F.col("range") > 10, "std": F.col("std") > 1.0, "paths": F.col("paths").between(5, 15)}
    return metrics.select("village", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("pass")) for n, c in rules.items()])).alias("r")).select("village", "r.rule", "r.pass")


def raster_dtm(points: DataFrame, res: float, stat: str, sigma: float = 1.0, by: By = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Smoothed terrain grid of a point table, its definition, and the filled cells before gaps are closed (durable); with by, the grids of all, which carry their nrows and ncols."""
    meta = durable(grid_meta(points, res, by))
    cells = durable(rasterise(cell_index(points, meta, by), stat, by))
    if not by:
        m = meta.first()
        return gaussian(fill_gaps(cells, m.nrows, m.ncols), m.nrows, m.ncols, sigma), meta, cells
    sized = cells.join(small(meta.select(*by, "nrows", "ncols")), list(by))
    keys = [*by, "nrows", "ncols"]
    return gaussian(fill_gaps(sized, "nrows", "ncols", by=keys), "nrows", "ncols", sigma, by=keys), meta, cells


def make_dtm(points: DataFrame, res: float, stat: str, sigma: float = 1.0, by: By = ()) -> tuple[DataFrame, DataFrame]:
    """Smoothed terrain grid of a point table, and its definition."""
    return raster_dtm(points, res, stat, sigma, by)[:2]


def method_comparison(methods: DataFrame, before: str, after: str) -> DataFrame:
    """(method, metric, value) rows side by side for two methods, with factor and percentage."""
    wide = methods.groupBy("metric").agg(*[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in (before, after)])
    x, y = F.col(before), F.col(after)
    return wide.withColumns({"factor": F.round(y / F.nullif(x, F.lit(0.0)), 6), "pct": F.round((y - x) / F.nullif(x, F.lit(0.0)) * 100, 6)})
